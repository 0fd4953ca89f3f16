"""Helpers shared by the operators: cutting lineage, free column names, global ranks, files on the shared folder."""

from __future__ import annotations

import ctypes
import math
import posixpath
from collections.abc import Sequence
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwise.session import checkpoint_dir


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder.

    It stays there unless ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set; then Spark's cleaner removes it with
    the last reference.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows and bytes that one task of a gathered table holds on average, and its fewest tasks.
TASK_ROWS, TASK_BYTES, LEAST_TASKS = 50_000, 32_000_000, 16


def gathered(df: DataFrame, rows: int, size: int = 0) -> DataFrame:
    """``df``, which has about so many rows and bytes, in no more partitions than these need.

    Every map task of a later shuffle leaves files of its own and every partition of a checkpoint is one, so small tables
    in many partitions fill the disk with almost empty files. Large ones keep their partitions.
    """
    return df.coalesce(max(LEAST_TASKS, math.ceil(rows / TASK_ROWS), math.ceil(size / TASK_BYTES)))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """Column by its exact name, dots included."""
    return F.col(f"`{name.replace('`', '``')}`")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, order: Sequence[Column], rank: str, running: dict[str, str] | None = None) -> DataFrame:
    """Global 0-based position in ``order`` and inclusive running sums, without a single-task window.

    ``running`` maps new columns to the long columns they add up. Rows are range-partitioned and sorted, the layout is
    fixed by a checkpoint, and each partition adds the totals of the earlier ones: one row per partition. ``order``
    should end in a tie-break, so that no value fills a partition alone.
    """
    running = running or {}
    spark = df.sparkSession
    part, slot = fresh(df, "__part", "__slot")
    sorted_rows = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    # The id holds the partition in its upper bits and the position inside it in the lower 33.
    placed = cut(sorted_rows.withColumn(slot, F.monotonically_increasing_id()))
    split = placed.withColumn(part, F.shiftright(slot, 33).cast("int")).withColumn(
        slot, F.col(slot).bitwiseAND(F.lit((1 << 33) - 1)))
    totals = split.groupBy(part).agg(
        F.count(F.lit(1)).alias(rank), *[F.sum(col(source)).alias(name) for name, source in running.items()])
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    names = [rank, *running]
    offsets = totals.select(part, *[  # one row per partition of the sort
        F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__before_{n}") for n in names])
    joined = split.join(F.broadcast(offsets), part)
    inside = Window.partitionBy(part).orderBy(slot).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(
        *[col(c) for c in df.columns],
        (F.col(f"__before_{rank}") + F.col(slot)).alias(rank),
        *[(F.col(f"__before_{n}") + F.coalesce(F.sum(col(s)).over(inside), F.lit(0))).alias(n)
          for n, s in running.items()],
    )


def new_folder(spark: SparkSession, kind: str) -> str:
    """Name of an unused folder below the shared one; whoever writes first makes it."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid4().hex}"


def give_back() -> None:
    """Return what this process has freed to the system; allocators keep it, and Python workers outlive their tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def open_filesystem(uri: str):
    """(file system, path) of a folder that driver and executors share."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


@contextmanager
def atomic_output(folder: str, name: str):
    """Open stream that appears as ``folder/name`` only once complete.

    A task that is lost or runs twice leaves the same file: each attempt writes its own temporary file and moves it.
    """
    system, base = open_filesystem(folder)
    system.create_dir(base, recursive=True)
    draft = posixpath.join(base, f".{name}.{uuid4().hex}")
    with system.open_output_stream(draft, compression=None) as stream:
        yield stream
    system.move(draft, posixpath.join(base, name))
