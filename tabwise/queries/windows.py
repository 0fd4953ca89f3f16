"""Trailing windows and calendar features over the events of a user."""

from pyspark.sql import functions as F

from tabwise.functions import layout as lay
from tabwise.functions.scalars import micros
from tabwise.operators import features as ops
from tabwise.operators import targets
from tabwise.plans import durations
from tabwise.plans.specs import DatasetSpec, FeatureSpec, TargetSpec
from tabwise.queries.registry import register, rounded, table

EVENTS = DatasetSpec("events", "Events", "user_id", "ts")
WINDOWS = ("6h", "24h")
DIGITS = {"slope": 9}  # a slope per second is small


def frame(window: str, name: str) -> str:
    reach = durations.micros(window) - 1
    return (f"{name} AS (PARTITION BY user_id ORDER BY epoch_us(ts) "
            f"RANGE BETWEEN {reach} PRECEDING AND CURRENT ROW)")


def window_sql(op: str, formula: str) -> str:
    """``formula`` with {w} in place of the window name."""
    columns = ", ".join(
        f"round({formula.format(w=f'w{i}')}, {DIGITS.get(op, 4)}) AS value_{op}_{w}" for i, w in enumerate(WINDOWS)
    )
    frames = ", ".join(frame(w, f"w{i}") for i, w in enumerate(WINDOWS))
    return f"""
    WITH e AS (SELECT *, CAST((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 1000000 AS DOUBLE) AS t
               FROM events)
    SELECT event_id, user_id, ts, {columns} FROM e WINDOW {frames}"""


def rolling(op: str, formula: str, path: str = "", **how):
    """Registers the windows of one operation; ``how`` forces the path that heavy or dense entities take."""
    spec = FeatureSpec.read("events", {"value": {"transforms": [{op: {"windows": list(WINDOWS)}}]}})

    @register(f"rolling_{op}{path}", window_sql(op, formula))
    def run(spark, folder):
        built, _ = ops.build_features(table(spark, folder, "events"), EVENTS, spec, keep=["event_id"], **how)
        return rounded(built, DIGITS.get(op, 4))

    return run


SLOPE = "CASE WHEN var_samp(t) OVER {w} > 0 THEN covar_pop(t, value) OVER {w} / var_samp(t) OVER {w} END"
rolling("mean", "avg(value) OVER {w}")
rolling("min", "min(value) OVER {w}")
rolling("max", "max(value) OVER {w}")
rolling("std", "stddev_samp(value) OVER {w}")
rolling("median", "median(value) OVER {w}")
rolling("slope", SLOPE)
rolling("delta", "value - min(value) OVER {w}")

CUT = lay.Layout(lay.DAY)  # every user in time buckets
rolling("mean", "avg(value) OVER {w}", "_cut", layout=CUT)
rolling("delta", "value - min(value) OVER {w}", "_cut", layout=CUT)
rolling("std", "stddev_samp(value) OVER {w}", "_dense", frame_rows=1)
rolling("max", "max(value) OVER {w}", "_dense", frame_rows=1)
rolling("slope", SLOPE, "_dense", frame_rows=1)
rolling("median", "median(value) OVER {w}", "_dense", frame_rows=1)


def calendar_spec():
    return FeatureSpec.read("events", {
        "value": {"transforms": ["current", "elapsed_time", "hour_of_day", "day_of_week"]},
    })


@register("calendar", """
    SELECT event_id, user_id, ts, value AS value_current,
           CAST((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 1000000 AS DOUBLE) AS elapsed_time,
           CAST(hour(ts) AS DOUBLE) AS hour_of_day, CAST(isodow(ts) AS DOUBLE) AS day_of_week
    FROM events""")
def calendar(spark, folder):
    return ops.build_features(table(spark, folder, "events"), EVENTS, calendar_spec(), keep=["event_id"])[0]


FLAGSHIP = FeatureSpec.read("events", {"value": {"transforms": [
    "current", {"mean": {"windows": ["6h", "24h"]}}, {"std": {"windows": ["24h"]}}, {"max": {"windows": ["24h"]}},
    {"slope": {"windows": ["24h"]}}, "hour_of_day", "day_of_week",
]}})
PURCHASE = TargetSpec("purchase_24h", "future_event", "event_type", "24h", "purchase")


@register("feature_matrix", f"""
    WITH e AS (SELECT *, CAST((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 1000000 AS DOUBLE) AS t
               FROM events)
    SELECT event_id, user_id, ts, value AS value_current, round(avg(value) OVER w6, 4) AS value_mean_6h,
           round(avg(value) OVER w24, 4) AS value_mean_24h, round(stddev_samp(value) OVER w24, 4) AS value_std_24h,
           max(value) OVER w24 AS value_max_24h,
           round(CASE WHEN var_samp(t) OVER w24 > 0 THEN covar_pop(t, value) OVER w24 / var_samp(t) OVER w24 END, 4)
               AS value_slope_24h,
           CAST(hour(ts) AS DOUBLE) AS hour_of_day, CAST(isodow(ts) AS DOUBLE) AS day_of_week,
           CAST(coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER
               (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 1 FOLLOWING AND 86400000000 FOLLOWING), 0)
               AS TINYINT) AS purchase_24h
    FROM e WINDOW {frame('6h', 'w6')}, {frame('24h', 'w24')}""")
def feature_matrix(spark, folder):
    """Training table: keys, trailing features, future label."""
    events = table(spark, folder, "events")
    layout = lay.measure(events, ["user_id"], micros("ts"))  # shared by label and windows
    labelled = targets.build_target(events, PURCHASE, EVENTS, layout)
    built, _ = ops.build_features(labelled, EVENTS, FLAGSHIP, keep=["event_id", PURCHASE.name], layout=layout)
    return rounded(built)


SHIPMENTS = DatasetSpec("lineitem", "Shipments", "l_suppkey", "l_shipdate")
WEEKLY = FeatureSpec.read("lineitem", {"l_quantity": {"transforms": [
    {"mean": {"windows": ["4w", "13w"]}}, {"max": {"windows": ["13w"]}}]}})


@register("rolling_weeks", f"""
    SELECT l_suppkey, l_shipdate, count(*) AS n, round(any_value(m4), 4) AS l_quantity_mean_4w,
           round(any_value(m13), 4) AS l_quantity_mean_13w, any_value(x13) AS l_quantity_max_13w
    FROM (SELECT l_suppkey, l_shipdate, avg(l_quantity) OVER w4 AS m4, avg(l_quantity) OVER w13 AS m13,
                 max(l_quantity) OVER w13 AS x13 FROM lineitem
          WINDOW w4 AS (PARTITION BY l_suppkey ORDER BY epoch_us(l_shipdate)
                        RANGE BETWEEN {durations.micros('4w') - 1} PRECEDING AND CURRENT ROW),
                 w13 AS (PARTITION BY l_suppkey ORDER BY epoch_us(l_shipdate)
                         RANGE BETWEEN {durations.micros('13w') - 1} PRECEDING AND CURRENT ROW))
    GROUP BY 1, 2""")
def rolling_weeks(spark, folder):
    """Windows of rows with equal times: every row of one (entity, time) sees the same window."""
    built, _ = ops.build_features(table(spark, folder, "lineitem"), SHIPMENTS, WEEKLY)
    names = ["l_quantity_mean_4w", "l_quantity_mean_13w", "l_quantity_max_13w"]
    return rounded(built.groupBy("l_suppkey", "l_shipdate").agg(
        F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in names]
    ))
