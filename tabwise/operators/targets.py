"""Label construction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwise.functions import layout as lay
from tabwise.functions import scalars
from tabwise.plans.specs import DatasetSpec, TargetSpec

US, NEXT = "__tus", "__next_us"


def binary_target(spec: TargetSpec) -> Column:
    return scalars.is_true(spec.source_column, spec.positive_class)


def regression_target(spec: TargetSpec) -> Column:
    return scalars.named(spec.source_column).cast("double")


def with_next_event(
    df: DataFrame, entity: str, time: str, event: Column, out: str = NEXT,
    include_current: bool = False, layout: lay.Layout | None = None,
) -> DataFrame:
    """Time (microseconds) of the entity's next row where ``event`` holds; null when none follows.

    Only the nearest event matters, so one running minimum from the future replaces a rows-times-events
    join, and a bucket of a heavy entity needs just one row carried in from the buckets after it.
    """
    names = df.columns
    work = df.withColumn(US, scalars.micros(time)).withColumn("__hit", F.coalesce(event, F.lit(False)))
    plan = lay.resolve(layout, work, [entity], F.col(US))
    work = lay.nearest_halo(work, [entity], US, F.col("__hit"), plan, later=True)
    ahead = Window.partitionBy(entity, lay.BUCKET).orderBy(F.desc(US)).rangeBetween(
        Window.unboundedPreceding, 0 if include_current else -1
    )
    work = work.withColumn(out, F.min(F.when(F.col("__hit"), F.col(US))).over(ahead))
    return lay.owned(work).select(*map(scalars.named, names), out)


def future_event_target(
    df: DataFrame, spec: TargetSpec, dataset: DatasetSpec, layout: lay.Layout | None = None
) -> DataFrame:
    """1 where a positive event of the same entity lies in ``(T, T + horizon]``; the current row never counts."""
    if spec.horizon_micros is None:
        raise ValueError(f"target {spec.name!r}: a future event needs a horizon")
    if not dataset.temporal:
        raise ValueError(f"target {spec.name!r}: a future event needs a time key")
    hit = scalars.named(spec.source_column) == F.lit(spec.positive_class)
    ahead = with_next_event(df, dataset.entity_key, dataset.time_key, hit, layout=layout)
    within = F.col(NEXT) - scalars.micros(dataset.time_key) <= F.lit(spec.horizon_micros)
    return ahead.withColumn(spec.name, F.coalesce(within, F.lit(False)).cast("tinyint")).drop(NEXT)


def build_target(
    df: DataFrame, spec: TargetSpec, dataset: DatasetSpec, layout: lay.Layout | None = None
) -> DataFrame:
    """Add the label column named by the spec."""
    if spec.source_column not in df.columns:
        raise ValueError(f"target source column {spec.source_column!r} is missing")
    if spec.type == "future_event":
        return future_event_target(df, spec, dataset, layout)
    value = regression_target(spec) if spec.is_regression else binary_target(spec)
    return df.withColumn(spec.name, value)


def select_target(df: DataFrame, spec: TargetSpec, dataset: DatasetSpec, keep: Sequence[str] = ()) -> DataFrame:
    return build_target(df, spec, dataset).select(*dataset.keys, *keep, spec.name)
