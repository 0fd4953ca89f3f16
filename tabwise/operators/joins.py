"""Time-aware joins: as-of lookup, first event within an interval, latest row per entity, small lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwise.functions import layout as lay
from tabwise.functions import scalars
from tabwise.operators.targets import with_next_event

AT, ROW, PAYLOAD = "__at", "__request", "__payload"


def latest_per_entity(
    df: DataFrame, entity: str, time: str, as_of=None, history: int | None = None, ties: Sequence[str] = ()
) -> DataFrame:
    """Last row per entity, optionally at or before one time (and within ``history`` microseconds of it)."""
    if as_of is not None:
        bound = F.lit(as_of).cast("timestamp")
        df = df.where(F.col(time) <= bound.cast(df.schema[time].dataType))
        if history is not None:
            earliest = scalars.shift_time(bound, -history)
            df = df.where(F.col(time) >= earliest.cast(df.schema[time].dataType))
    order = F.struct(scalars.micros(time), *[F.col(t) for t in ties])
    rest = [c for c in df.columns if c != entity]
    best = df.groupBy(scalars.named(entity)).agg(
        F.max_by(F.struct(*map(scalars.named, rest)), order).alias(PAYLOAD)
    )
    return best.select(scalars.named(entity), f"{PAYLOAD}.*").select(*map(scalars.named, df.columns))


def as_of_join(
    requests: DataFrame, observations: DataFrame, entity: str, request_time: str, time: str,
    ties: Sequence[str] = (), prefix: str = "", layout: lay.Layout | None = None,
) -> DataFrame:
    """Every request with the entity's last observation at or before its time (nulls where there is none).

    Requests and observations go through one shuffle and one running pass; a bucket of a heavy entity
    gets the last earlier observation carried in.
    """
    payload = [c for c in observations.columns if c != entity]
    clash = [c for c in payload if prefix + c in requests.columns]
    if clash:
        raise ValueError(f"columns on both sides: {clash}; give a prefix")
    seen = observations.select(
        F.col(entity).alias("__e"), scalars.micros(time).alias(AT), F.lit(0).alias("__kind"),
        F.struct(*map(scalars.named, payload)).alias(PAYLOAD),
        F.struct(*[F.col(t) for t in ties] or [F.lit(0).alias("t")]).alias("__tie"),
    )
    asked = requests.select(
        F.col(entity).alias("__e"), scalars.micros(request_time).alias(AT), F.lit(1).alias("__kind"),
        F.struct(*map(scalars.named, requests.columns)).alias(ROW),
    )
    both = seen.unionByName(asked, allowMissingColumns=True)
    plan = lay.resolve(layout, both, ["__e"], F.col(AT))
    # Ties decide which of several observations at one time is the last one.
    order = F.struct(AT, "__tie")
    if plan.whole:
        placed = both.withColumn(lay.BUCKET, F.lit(0).cast("long")).withColumn(lay.OWN, F.lit(True))
    else:
        placed = _carry(both, plan, order)
    upto = Window.partitionBy("__e", lay.BUCKET).orderBy(AT, "__kind", "__tie").rowsBetween(
        Window.unboundedPreceding, 0
    )
    found = placed.withColumn("__last", F.last(PAYLOAD, ignorenulls=True).over(upto))
    return found.where((F.col("__kind") == 1) & F.col(lay.OWN)).select(
        f"{ROW}.*", *[F.col("__last")[c].alias(prefix + c) for c in payload]
    )


def _carry(both: DataFrame, plan: lay.Layout, order) -> DataFrame:
    placed = both.withColumn(lay.BUCKET, plan.bucket(F.col(AT)))
    observed = F.col("__kind") == 0
    names = [AT, "__kind", PAYLOAD, "__tie"]
    edge = placed.groupBy("__e", lay.BUCKET).agg(
        F.max_by(F.when(observed, F.struct(*names)), F.when(observed, order)).alias("__edge")
    )
    across = Window.partitionBy("__e").orderBy(lay.BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = edge.withColumn("__edge", F.last("__edge", ignorenulls=True).over(across)).where(
        F.col("__edge").isNotNull()
    ).select("__e", "__edge.*", lay.BUCKET, F.lit(False).alias(lay.OWN))
    return placed.withColumn(lay.OWN, F.lit(True)).unionByName(carried, allowMissingColumns=True)


def first_within(
    left: DataFrame, right: DataFrame, entity: str, left_time: str, right_time: str, within: int,
    out: str = "first_time", flag: str = "has_event", layout: lay.Layout | None = None,
) -> DataFrame:
    """Left rows with the first right time of the entity in ``(left, left + within]`` and whether there is one.

    Both tables share one shuffle and one running pass from the future; matching pairs are never formed.
    """
    asked = left.select(
        F.col(entity).alias("__e"), scalars.from_micros(scalars.micros(left_time)).alias(AT),
        F.lit(False).alias("__event"), F.struct(*map(scalars.named, left.columns)).alias(ROW),
    )
    events = right.select(
        F.col(entity).alias("__e"), scalars.from_micros(scalars.micros(right_time)).alias(AT),
        F.lit(True).alias("__event"),
    )
    both = asked.unionByName(events, allowMissingColumns=True)
    ahead = with_next_event(both, "__e", AT, F.col("__event"), "__first_us", layout=layout)
    near = F.col("__first_us") - scalars.micros(AT) <= F.lit(within)
    return ahead.where(F.col(ROW).isNotNull()).select(
        f"{ROW}.*", F.when(near, scalars.from_micros("__first_us")).alias(out),
        F.coalesce(near, F.lit(False)).alias(flag),
    )


def attach_label(features: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Features with a label computed in another table; one label row per key, so rows never multiply.

    Of several rows the greatest is taken as a whole, compared column by column.
    """
    values = [c for c in labels.columns if c not in keys]
    single = labels.groupBy(*keys).agg(F.max(F.struct(*values)).alias("__row")).select(*keys, "__row.*")
    return features.join(single, list(keys), "left")


def lookup(df: DataFrame, dimension: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Attributes of a dimension table by key; Spark broadcasts it when its measured size allows."""
    return df.join(dimension.select(key, *columns), key, "left")
