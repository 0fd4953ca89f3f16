"""Sharding along a Hilbert curve, with DataFrame functions alone.

Several metadata dimensions are quantised to ``BITS`` bits each, rows are sorted by their index on the Hilbert curve
through that grid, and the sorted rows are cut into runs of equal row counts. A run covers a compact region of all
dimensions at once, so minima and maxima of each shard's files prune on any of them.

Numbers are quantised at approximate quantiles, strings by the rank of their distinct values, so both keep their order
and use the whole grid whatever their distribution. Rank and cut are exact; quantiles only shape the curve.

Defined results. Null in a dimension is cell 0. Null texts have no bytes and the checksum of the empty text; null ids
sort first. Rows equal in curve index are ordered by doc_id, checksum and size; rows equal in those too are
interchangeable. Shards beyond the row count stay empty. Other columns stay as they are.

Scale. Rows are ranked by one range partitioning of narrow rows; texts are read for their size and checksum only. The
driver sees quantiles and totals per partition. ``write_shards`` numbers the rows in a checkpoint and sends each text
twice: to its place by that number, then to the range it belongs to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tabwise.llm.common import col, cut, fresh, ranked

SHARDS = 40
BITS = 6
ROW_OVERHEAD = 16
DIMENSIONS = ("source", "lang", "doc_id", "size")


def _below(bounds: Column, value: Column) -> Column:
    return F.filter(bounds, lambda b: b < value)


def _number_cells(df: DataFrame, names: Sequence[str], bits: int) -> list[Column]:
    """Cells 1 .. 2^bits - 1 by approximate quantiles, 0 for null; one pass for all columns."""
    edges = (1 << bits) - 2
    shares = F.array(*[F.lit(i / (edges + 1)) for i in range(1, edges + 1)])
    found = df.agg(*[F.percentile_approx(c, shares, 100 * edges).alias(c) for c in names]).first()
    cells = []
    for c in names:
        bounds = F.array(*[F.lit(x) for x in sorted(set(found[c] or []))])
        below = F.size(_below(bounds, F.col(c)))
        cells.append(F.when(F.col(c).isNotNull(), below + 1).otherwise(0).cast("int"))
    return cells


def _string_cells(df: DataFrame, name: str, bits: int, cell: str) -> DataFrame:
    """Adds the cell of a string column: the rank of its value among the distinct ones, scaled to the grid."""
    values = ranked(df.select(F.col(name).alias("__value")).where("__value IS NOT NULL").distinct(),
                    [F.col("__value")], "__rank")
    values = cut(values)
    n = max(1, values.count())
    scaled = (F.lit(1) + F.floor(F.col("__rank") * ((1 << bits) - 1) / F.lit(n))).cast("int").alias(cell)
    return df.join(values.select("__value", scaled), F.col(name) == F.col("__value"), "left").drop("__value").withColumn(
        cell, F.coalesce(cell, F.lit(0)))


def hilbert(df: DataFrame, cells: Sequence[str], bits: int, index: str) -> DataFrame:
    """Replaces the cell columns by their index on the curve.

    Walks from the coarsest bit down, undoing the turn and reflection that each level of the curve applies to the levels
    below it, then reads the cells as a Gray code whose bits interleave to the index.
    """
    for b in range(bits - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        for c in cells:
            flip = F.col(c).bitwiseAND(bit) != 0
            swap = F.col(cells[0]).bitwiseXOR(F.col(c)).bitwiseAND(low)
            head = F.when(flip, F.col(cells[0]).bitwiseXOR(F.lit(low))).otherwise(F.col(cells[0]).bitwiseXOR(swap))
            if c == cells[0]:
                df = df.withColumn(c, F.when(flip, F.col(c).bitwiseXOR(F.lit(low))).otherwise(F.col(c)))
            else:
                df = df.withColumns({cells[0]: head, c: F.when(flip, F.col(c)).otherwise(F.col(c).bitwiseXOR(swap))})
    for before, c in zip(cells, cells[1:]):
        df = df.withColumn(c, F.col(c).bitwiseXOR(F.col(before)))
    turned = F.lit(0)
    for b in range(bits - 1, 0, -1):
        turned = turned.bitwiseXOR(F.when(F.col(cells[-1]).bitwiseAND(1 << b) != 0, (1 << b) - 1).otherwise(0))
    df = df.withColumn(index, turned)
    df = df.withColumns({c: F.col(c).bitwiseXOR(F.col(index)) for c in cells})
    total = F.lit(0).cast("long")
    for b in range(bits):
        for place, c in enumerate(cells):
            moved = F.shiftleft(F.shiftright(F.col(c), b).bitwiseAND(1).cast("long"),
                                b * len(cells) + len(cells) - 1 - place)
            total = total.bitwiseOR(moved)
    return df.withColumn(index, total).drop(*cells)


def on_curve(df: DataFrame, dimensions: Sequence[str], index: str, bits: int = BITS) -> DataFrame:
    """Add the curve index of the given columns."""
    if bits * len(dimensions) > 62:
        raise ValueError("the curve index must fit 62 bits")
    cells = fresh(df, *[f"__cell{i}" for i in range(len(dimensions))])
    strings = [(d, c) for d, c in zip(dimensions, cells) if isinstance(df.schema[d].dataType, StringType)]
    numbers = [(d, c) for d, c in zip(dimensions, cells) if not isinstance(df.schema[d].dataType, StringType)]
    if numbers:
        df = df.withColumns(dict(zip([c for _, c in numbers], _number_cells(df, [d for d, _ in numbers], bits))))
    for name, cell in strings:
        df = _string_cells(df, name, bits, cell)
    return hilbert(df, cells, bits, index)


def _keyed(docs: DataFrame, number: Sequence[str] = ()) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", "source", "lang", (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), *number)


ORDER = ("curve", "doc_id", "text_crc32", "size")


def assign(docs: DataFrame, shards: int = SHARDS, bits: int = BITS, number: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard and slot of every document; shard sizes differ by one row at most.

    Columns in ``number`` are kept and order the rows that are equal otherwise.
    """
    rows = cut(on_curve(_keyed(docs, number), DIMENSIONS, "curve", bits))
    n = max(1, rows.count())
    placed = ranked(rows, [F.col(c) for c in (*ORDER, *number)], "rank")
    shard = F.expr(f"(rank * {shards}L) div {n}L")
    first = F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("rank") - first).select(
        "doc_id", "size", "text_crc32", "curve", F.col("shard").cast("int").alias("shard"), "slot", *number)


def report(docs: DataFrame) -> DataFrame:
    """Shard and slot of every document under the law of equal row counts."""
    return assign(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, bits: int = BITS) -> None:
    """Write all columns as Parquet, one folder per shard, rows along the curve.

    Shard and slot are those of ``assign``; they come back to the texts by a row number that a checkpoint fixes, so
    repeated rows are split as there.
    """
    names = [f"__c{i}" for i in range(len(docs.columns))]
    wanted = ("doc_id", "source", "lang", "text")
    given = docs.toDF(*names).withColumnsRenamed({n: c for n, c in zip(names, docs.columns) if c in wanted})
    numbered = cut(given.withColumn("__row", F.monotonically_increasing_id()))
    placed = cut(assign(numbered, shards, bits, ["__row"]).select("__row", "shard", "slot"))
    dealt = numbered.join(placed, "__row").repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.select("shard", *[col(c if c in wanted else n).alias(c) for n, c in zip(names, docs.columns)]).write.partitionBy(
        "shard").parquet(folder)
