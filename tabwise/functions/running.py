"""Running totals in a global order, without a single-task window.

Values are cut into ordered buckets at approximate quantiles (bounds only balance the work;
any bounds give the exact totals), each bucket is accumulated on its own, and the totals of
earlier buckets, one row each, are added.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isfinite

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SINGLE_TASK_ROWS = 200_000
# Rows aimed at per bucket, and bounds on the number of buckets.
BUCKET_ROWS = 500_000
FEWEST, MOST = 16, 8192


def running_totals(
    df: DataFrame, order: str, columns: Sequence[str], descending: bool = True,
    single_task_rows: int = SINGLE_TASK_ROWS, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add ``cum_{c}`` (inclusive) for every column; ``order`` must be distinct in ``df``."""
    direction = F.desc(order) if descending else F.asc(order)
    rows = df.count()
    if rows <= single_task_rows:
        single = Window.orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(single).alias(f"cum_{c}") for c in columns])
    buckets = max(FEWEST, min(MOST, rows // bucket_rows))
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = df.select(F.percentile_approx(F.col(order).cast("double"), cuts, 10 * buckets)).first()[0]
    splits = [float("-inf"), *sorted({b for b in bounds if isfinite(b)}), float("inf")]
    # NaN is the largest value, as in Spark's own order, and takes the last cell.
    placed = Bucketizer(splits=splits, inputCol="__x", outputCol="__cell", handleInvalid="keep").transform(
        df.withColumn("__x", F.col(order).cast("double"))
    ).drop("__x")
    totals = placed.groupBy("__cell").agg(*[F.sum(c).alias(f"__t_{c}") for c in columns])
    earlier = Window.orderBy(F.desc("__cell") if descending else F.asc("__cell")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(  # one row per bucket
        "__cell", *[F.coalesce(F.sum(f"__t_{c}").over(earlier), F.lit(0)).alias(f"__t_{c}") for c in columns]
    )
    inside = Window.partitionBy("__cell").orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(F.broadcast(offsets), "__cell")
    summed = joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.sum(c).over(inside) + F.col(f"__t_{c}")).alias(f"cum_{c}") for c in columns],
    )
    return summed
