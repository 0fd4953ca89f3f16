"""Streaming jobs over the events table, read as a file stream to its end."""

from uuid import uuid4

from pyspark.sql import functions as F

from tabwise.plans.specs import DatasetSpec, FeatureSpec, TargetSpec
from tabwise.queries.registry import register, rounded, table
from tabwise.operators import features
from tabwise.plans import durations
from tabwise.queries.models import trained
from tabwise.queries.windows import SHIPMENTS, SLOPE, frame
from tabwise.session import checkpoint_dir
from tabwise.streaming.labels import delayed_labels
from tabwise.streaming.rolling import rolling_features, score_stream
from tabwise.streaming.state import ROCKSDB
from tabwise.streaming.validation import validate_stream, validator

EVENTS = DatasetSpec.read({
    "dataset_id": "events", "entity_key": "user_id", "time_key": "ts",
    "columns": {"user_id": {"type": "numeric", "role": "identifier"}, "ts": {"type": "timestamp"},
                "event_type": {"type": "categorical"}, "value": {"type": "numeric"}},
})
SPEC = FeatureSpec.read("events", {"value": {"transforms": [
    {"mean": {"windows": ["6h", "24h"]}}, {"std": {"windows": ["24h"]}}, {"max": {"windows": ["6h"]}}]}})
PURCHASE = TargetSpec("purchase_24h", "future_event", "event_type", "24h", "purchase")
# Watermark of the run: the latest time minus one hour, in whole milliseconds.
CLOSED_SQL = "(SELECT (max(epoch_us(ts)) // 1000 - 3600000) * 1000 FROM events)"


def event_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def run_to_end(spark, make, columns):
    """Run a stream over what is there now and return the written table."""
    place = f"{checkpoint_dir(spark)}/stream-{uuid4().hex}"
    provider, partitions = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
    before = {key: spark.conf.get(key) for key in (provider, partitions)}
    spark.conf.set(provider, ROCKSDB)
    # State partitions stay for the life of a stream: one per core of the cluster, as every one keeps a store.
    spark.conf.set(partitions, str(min(int(before[partitions]), spark.sparkContext.defaultParallelism)))
    try:
        query = (
            make.writeStream.format("parquet").option("path", f"{place}/out").outputMode("append")
            .option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(make.schema).parquet(f"{place}/out").select(*columns)


@register("stream_rolling_features", f"""
    SELECT event_id, user_id, value_mean_6h, value_mean_24h, value_std_24h, value_max_6h FROM (
        SELECT event_id, user_id, ts, round(avg(value) OVER w6, 4) AS value_mean_6h,
               round(avg(value) OVER w24, 4) AS value_mean_24h, round(stddev_samp(value) OVER w24, 4) AS value_std_24h,
               max(value) OVER w6 AS value_max_6h
        FROM events WINDOW {frame('6h', 'w6')}, {frame('24h', 'w24')}) WHERE epoch_us(ts) <= {CLOSED_SQL}""")
def stream_rolling_features(spark, folder):
    """Rows the watermark has passed, with the features the batch operator gives them."""
    out = rolling_features(event_stream(spark, folder), EVENTS, SPEC, keep=["event_id"])
    names = ["event_id", "user_id", "value_mean_6h", "value_mean_24h", "value_std_24h", "value_max_6h"]
    return rounded(run_to_end(spark, out, names))


@register("stream_delayed_labels", f"""
    SELECT event_id, user_id, purchase_24h FROM (
        SELECT event_id, user_id, ts, CAST(coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER
               (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 1 FOLLOWING AND 86400000000 FOLLOWING), 0)
               AS TINYINT) AS purchase_24h FROM events)
    WHERE epoch_us(ts) + 86400000000 <= {CLOSED_SQL}""")
def stream_delayed_labels(spark, folder):
    out = delayed_labels(event_stream(spark, folder), EVENTS, PURCHASE, keep=["event_id"])
    return run_to_end(spark, out, ["event_id", "user_id", "purchase_24h"])


@register("stream_validation", "SELECT count(*) AS n_rows, 0 AS n_late, 0 AS n_findings FROM events")
def stream_validation(spark, folder):
    place = f"{checkpoint_dir(spark)}/stream-{uuid4().hex}"
    validate_stream(event_stream(spark, folder), EVENTS, f"{place}/out", f"{place}/checkpoint").awaitTermination()
    read = lambda name: spark.read.parquet(f"{place}/out/{name}").agg(F.count(F.lit(1)).alias(f"n_{name}"))
    counts = read("rows").crossJoin(read("late")).crossJoin(read("report"))
    return counts.select("n_rows", F.col("n_late").cast("int").alias("n_late"),
                         F.col("n_report").cast("int").alias("n_findings"))


TRENDS = FeatureSpec.read("events", {"value": {"transforms": [
    "elapsed_time", {"slope": {"windows": ["24h"]}}, {"min": {"windows": ["6h", "24h"]}}, {"median": {"windows": ["6h"]}}]}})


@register("stream_trends", f"""
    SELECT event_id, user_id, value_slope_24h, value_min_6h, value_min_24h, value_median_6h, elapsed_time FROM (
        SELECT event_id, user_id, ts, t AS elapsed_time, round({SLOPE.format(w='w24')}, 9) AS value_slope_24h,
               min(value) OVER w6 AS value_min_6h, min(value) OVER w24 AS value_min_24h,
               round(median(value) OVER w6, 9) AS value_median_6h
        FROM (SELECT *, CAST((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 1000000 AS DOUBLE) AS t
              FROM events) WINDOW {frame('6h', 'w6')}, {frame('24h', 'w24')}) WHERE epoch_us(ts) <= {CLOSED_SQL}""")
def stream_trends(spark, folder):
    """Windows that count from a user's first event, with that time kept in state."""
    out = rolling_features(event_stream(spark, folder), EVENTS, TRENDS, keep=["event_id"])
    names = ["event_id", "user_id", "value_slope_24h", "value_min_6h", "value_min_24h", "value_median_6h", "elapsed_time"]
    return rounded(run_to_end(spark, out, names), 9)


@register("stream_scores", f"""
    SELECT event_id, user_id, TRUE AS agrees FROM events WHERE epoch_us(ts) <= {CLOSED_SQL}""")
def stream_scores(spark, folder):
    """Every closed event scored as it arrives, beside the score of the batch operators for the same row."""
    events, model = trained(spark, folder, "logistic_regression")
    scored = score_stream(event_stream(spark, folder), model, keep=["event_id"])
    streamed = run_to_end(spark, scored, ["event_id", "user_id", "prediction"])
    built, _ = features.build_features(events, model.config.dataset, model.config.features, model.fitted, ["event_id"])
    batch = model.transform(built).select("event_id", F.col("prediction").alias("expected"))
    both = streamed.join(batch, "event_id", "left")
    return both.select("event_id", "user_id", (F.abs(F.col("prediction") - F.col("expected")) < 1e-9).alias("agrees"))


LATE = "52w"
ARRIVED = f"""
    b AS (SELECT l_suppkey, l_shipdate, l_orderkey % 3 AS k FROM lineitem),
    m AS (SELECT max(CASE WHEN k = 0 THEN l_shipdate END) AS m0, max(CASE WHEN k < 2 THEN l_shipdate END) AS m1 FROM b),
    r AS (SELECT b.*, CASE k WHEN 0 THEN FALSE WHEN 1 THEN epoch_us(l_shipdate) < epoch_us(m0) - {durations.micros(LATE)}
                      ELSE epoch_us(l_shipdate) < epoch_us(m1) - {durations.micros(LATE)} END AS late FROM b, m)"""


@register("stream_validation_late", f"""
    WITH {ARRIVED},
    d AS (SELECT k, count(*) AS n FROM (SELECT k, l_suppkey, l_shipdate FROM r WHERE NOT late GROUP BY 1, 2, 3
                                        HAVING count(*) > 1) GROUP BY k)
    SELECT (SELECT count(*) FROM r WHERE NOT late) AS n_rows, (SELECT count(*) FROM r WHERE late) AS n_late,
           (SELECT count(*) FROM d) AS n_findings, (SELECT CAST(sum(n) AS BIGINT) FROM d) AS n_duplicates""")
def stream_validation_late(spark, folder):
    """Three micro-batches, the later ones with many late rows, each with duplicate keys."""
    place = f"{checkpoint_dir(spark)}/stream-{uuid4().hex}"
    handle = validator(SHIPMENTS, place, LATE)
    shipments = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_shipdate").cast("timestamp"))
    for k in range(3):
        handle(shipments.where(F.col("l_orderkey") % 3 == k), k)
    count = lambda name, *more: spark.read.parquet(f"{place}/{name}").agg(F.count(F.lit(1)).alias(f"n_{name}"), *more)
    report = count("report", F.sum("n_violations").alias("n_duplicates"))
    return count("rows").crossJoin(count("late")).crossJoin(report).withColumnRenamed("n_report", "n_findings")
