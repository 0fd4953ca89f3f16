"""How rows of one entity are spread over tasks.

A window partitioned by entity puts the whole entity in one task, which fails when one
entity holds a third of the table. The operators therefore partition by (entity, time
bucket) and add to every bucket the few neighbouring rows its frames can reach ("halo"),
drop those copies afterwards, and get exactly the rows of the plain window. Where the
measured table has no heavy entity the bucket is one per entity and no copy is made.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwise.functions.scalars import named

DAY = 86_400_000_000
# Bucket of the rows without a time; they form a window of their own, as nulls do in a plain one.
TIMELESS = -(1 << 62)
# Rows one task may sort for one entity before the entity is cut into time buckets.
TASK_ROWS = 1_000_000

BUCKET, OWN = "__bucket", "__own"


@dataclass(frozen=True)
class Layout:
    """``width`` microseconds per time bucket; None keeps every entity whole."""

    width: int | None = None
    rows_per_day: int = 0

    @property
    def whole(self) -> bool:
        return self.width is None

    def at_least(self, span: int) -> Layout:
        return self if self.whole else Layout(max(self.width, span), self.rows_per_day)

    def bucket(self, us: Column) -> Column:
        if self.whole:
            return F.lit(0).cast("long")
        return F.coalesce(F.floor(us / F.lit(self.width)).cast("long"), F.lit(TIMELESS))


WHOLE = Layout()


def _densest(df: DataFrame, keys: Sequence[str], us: Column, width: int) -> int:
    counts = df.where(us.isNotNull()).groupBy(*keys, F.floor(us / F.lit(width)).alias("__slot")).count()
    return counts.agg(F.max("count")).first()[0] or 0


def measure(df: DataFrame, keys: Sequence[str], us: Column, task_rows: int = TASK_ROWS) -> Layout:
    """Pick the bucket width from the densest entity; reads only keys and time, counts map-side.

    Where an entity is heavy the width is checked and narrowed again, as its rows may come in bursts.
    """
    daily = df.select(*keys, F.floor(us / DAY).alias("__day")).groupBy(*keys, "__day").count()
    per_entity = daily.groupBy(*keys).agg(F.sum("count").alias("__n"), F.max("count").alias("__d"))
    total, densest = per_entity.agg(F.max("__n"), F.max("__d")).first()
    if (total or 0) <= task_rows:
        return Layout(None, densest or 0)
    width = max(1, DAY * task_rows // densest)
    before = None
    while width > 1 and (held := _densest(df, keys, us, width)) > 4 * task_rows and held != before:
        # Once narrowing no longer helps, one time holds the rows, and no width separates them.
        before, width = held, max(1, width * task_rows // held)
    return Layout(width, densest)


def resolve(layout: Layout | None, df: DataFrame, keys: Sequence[str], us: Column) -> Layout:
    return layout if layout is not None else measure(df, keys, us)


def range_halo(df: DataFrame, us: Column, layout: Layout, before: int = 0, after: int = 0) -> DataFrame:
    """Send every row to its own bucket and to those whose rows look back ``before`` or ahead ``after`` to it."""
    if layout.whole:
        return df.withColumn(BUCKET, layout.bucket(us)).withColumn(OWN, F.lit(True))
    first, last = layout.bucket(us - F.lit(after)), layout.bucket(us + F.lit(before))
    return df.withColumn(BUCKET, F.explode(F.sequence(first, last))).withColumn(
        OWN, F.col(BUCKET) == layout.bucket(us)
    )


def with_extreme(
    df: DataFrame, entity: str, us: str, out: str, latest: bool, layout: Layout
) -> DataFrame:
    """The entity's first (or latest) time on every row, without gathering a heavy entity or joining on it."""
    pick = F.max if latest else F.min
    if layout.whole:
        return df.withColumn(out, pick(us).over(Window.partitionBy(entity)))
    slot = layout.bucket(F.col(us))
    per_bucket = df.groupBy(F.col(entity).alias("__xe"), slot.alias("__xb")).agg(pick(us).alias(out))
    per_bucket = per_bucket.withColumn(out, pick(out).over(Window.partitionBy("__xe")))
    same = F.col(entity).eqNullSafe(F.col("__xe")) & (slot == F.col("__xb"))
    return df.join(per_bucket, same, "inner").drop("__xe", "__xb")


def owned(df: DataFrame) -> DataFrame:
    return df.where(F.col(OWN)).drop(OWN, BUCKET)


def nearest_halo(
    df: DataFrame, keys: Sequence[str], us: str, marker: Column, layout: Layout, later: bool
) -> DataFrame:
    """Buckets plus, in each, one copy of the nearest marked row outside it.

    ``later`` brings the first marked row of the following buckets, otherwise the last marked row of
    the preceding ones. Each bucket shrinks to one row before the per-entity pass over buckets.
    """
    if layout.whole:
        return df.withColumn(BUCKET, layout.bucket(F.col(us))).withColumn(OWN, F.lit(True))
    placed = df.withColumn(BUCKET, layout.bucket(F.col(us)))
    payload = F.struct(*map(named, df.columns))
    pick = F.min_by if later else F.max_by
    edge = placed.groupBy(*keys, BUCKET).agg(
        pick(F.when(marker, payload), F.when(marker, F.col(us))).alias("__edge")
    )
    order = F.desc(BUCKET) if later else F.asc(BUCKET)
    across = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        edge.withColumn("__edge", F.last("__edge", ignorenulls=True).over(across))
        .where(F.col("__edge").isNotNull())
        .select("__edge.*", BUCKET, F.lit(False).alias(OWN))
    )
    return placed.withColumn(OWN, F.lit(True)).unionByName(carried)


def row_halo(
    df: DataFrame, keys: Sequence[str], us: str, ties: Sequence[str], layout: Layout, before: int, after: int,
    chunk_rows: int = TASK_ROWS,
) -> DataFrame:
    """Chunks of consecutive rows per entity with ``before``/``after`` neighbour rows copied in.

    Adds ``__pos`` (row position within the entity) to order by. Positions of heavy entities come from
    bucket counts plus a row number inside the bucket, so no task sees a whole heavy entity.
    """
    inside = Window.partitionBy(*keys, BUCKET).orderBy(us, *ties)
    placed = df.withColumn(BUCKET, layout.bucket(F.col(us)))
    numbered = placed.withColumn("__pos", F.row_number().over(inside).cast("long") - 1)
    if layout.whole:
        return numbered.withColumn(OWN, F.lit(True))
    across = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*keys, BUCKET).count().select(
        *[F.col(k).alias(f"__o_{k}") for k in keys], F.col(BUCKET).alias("__o_bucket"),
        F.coalesce(F.sum("count").over(across), F.lit(0)).alias("__offset"),
    )
    same = F.col(BUCKET) == F.col("__o_bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__o_{k}"))
    placed = numbered.join(offsets, same, "inner").withColumn("__pos", F.col("__pos") + F.col("__offset"))
    placed = placed.drop("__offset", "__o_bucket", *[f"__o_{k}" for k in keys])
    chunk = lambda pos: F.floor(pos / F.lit(chunk_rows)).cast("long")
    first, last = chunk(F.col("__pos") - F.lit(after)), chunk(F.col("__pos") + F.lit(before))
    return placed.withColumn(BUCKET, F.explode(F.sequence(first, last))).withColumn(
        OWN, F.col(BUCKET) == chunk(F.col("__pos"))
    )
