"""Every asked row against every row of a table, in blocks, on the cluster.

Rows are packed into blocks, each one row with an Arrow batch as bytes. A unit of work is one block of asked rows with one
strip of row blocks; both are of bounded size whatever the tables hold. Nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwise.llm.common import cut

ASKED_ROWS, ASKED_BYTES = 1024, 8_000_000
BLOCK_ROWS, BLOCK_BYTES = 1024, 1_000_000
STRIP_BYTES = 16_000_000


def to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_bytes(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload).read_next_batch()


def packed(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows as blocks: payload and its size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, size = [], 0, 0

        def block() -> pa.RecordBatch:
            payload = to_bytes(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            return pa.record_batch([pa.array([payload], pa.binary())], ["payload"])

        for whole in batches:
            step = max(1, min(block_rows, whole.num_rows * block_bytes // max(1, whole.nbytes)))
            for start in range(0, whole.num_rows, step):
                part = whole.slice(start, step)
                if held and (count + part.num_rows > block_rows or size + part.nbytes > block_bytes):
                    yield block()
                    held, count, size = [], 0, 0
                held.append(part)
                count, size = count + part.num_rows, size + part.nbytes
        if held:
            yield block()

    return rows.mapInArrow(run, "payload binary")


def matrices(lists: pa.Array, convert: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of a column of lists."""
    flat = convert(lists.flatten().to_numpy(zero_copy_only=False))
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    for width in np.unique(lengths):
        at = np.flatnonzero(lengths == width)
        yield at, flat[starts[at][:, None] + np.arange(width)]


def cross(asked: DataFrame, key: str, rows: DataFrame, task: Callable, schema: str,
          asked_rows: int = ASKED_ROWS, strip_bytes: int = STRIP_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``task(asked batch, iterator of row batches)`` gives a record batch per unit; together the rows of the result.

    ``key`` is a column of ``asked`` that is spread well; a block of asked rows holds about ``asked_rows`` of them.
    """
    spark = asked.sparkSession
    blocks = cut(packed(rows, block_rows).withColumn("block", F.monotonically_increasing_id()))
    many, size = blocks.agg(F.count(F.lit(1)), F.sum(F.octet_length("payload"))).first()
    asked = cut(asked)
    wanted, wide = asked.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    lots = max(1, ceil(wanted / max(1, min(asked_rows, ASKED_BYTES // (8 * max(1, wide or 1))))))
    spread = ceil(spark.sparkContext.defaultParallelism / lots)  # small tables use all cores too
    strips = max(1, ceil((size or 0) / strip_bytes), min(many, spread))

    def together(table: pa.Table) -> pa.Table:
        lot = table.column("lot")[0].as_py()
        batch = table.drop_columns(["lot"]).combine_chunks().to_batches()[0]
        return pa.table({"lot": pa.array([lot], pa.int64()), "payload": pa.array([to_bytes(batch)], pa.binary())})

    grouped = asked.withColumn("lot", F.pmod(F.xxhash64(key), F.lit(lots))).groupBy("lot").applyInArrow(
        together, "lot long, payload binary")
    zero = F.lit(0).cast("long")
    left = grouped.select("lot", F.explode(F.sequence(zero, F.lit(strips - 1).cast("long"))).alias("strip"),
                          F.lit(0).alias("side"), "payload")
    right = blocks.select(F.explode(F.sequence(zero, F.lit(lots - 1).cast("long"))).alias("lot"),
                          F.pmod(F.xxhash64("block"), F.lit(strips)).alias("strip"), F.lit(1).alias("side"), "payload")

    def unit(table: pa.Table) -> pa.Table:
        sides, payloads = table.column("side").to_numpy(), table.column("payload")
        first = np.flatnonzero(sides == 0)
        if not len(first):
            return task(None, iter(()))  # no asked row has this lot
        others = (from_bytes(payloads[int(i)].as_py()) for i in np.flatnonzero(sides == 1))
        return task(from_bytes(payloads[int(first[0])].as_py()), others)

    return left.unionByName(right).groupBy("lot", "strip").applyInArrow(unit, schema)
