"""Reading: type coercion, time-bounded scans, records without keys, stage-restricted inputs."""

from pyspark.sql import functions as F

from tabwise.operators import features, scoring
from tabwise.operators import filters as flt
from tabwise.plans.specs import DatasetSpec, FeatureSpec
from tabwise.queries.registry import register, rounded, table
from tabwise.sources import readers

TEXT_ORDERS = DatasetSpec.read({"dataset_id": "orders", "entity_key": "o_orderkey", "time_key": "ordered", "columns": {
    "ordered": {"type": "timestamp"}, "price": {"type": "numeric"}, "finished": {"type": "boolean"},
    "o_orderpriority": {"type": "categorical"}, "absent": {"type": "numeric"}}})


@register("coerce_types", """
    WITH t AS (SELECT o_orderkey, o_orderpriority,
        CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS ordered,
        CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE CAST(o_orderkey AS VARCHAR) || '.5' END AS price,
        CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '0' ELSE '?' END AS finished FROM orders)
    SELECT o_orderkey, o_orderpriority, TRY_CAST(ordered AS TIMESTAMP) AS ordered, TRY_CAST(price AS DOUBLE) AS price,
           TRY_CAST(finished AS TINYINT) AS finished FROM t""")
def coerce_types(spark, folder):
    """Text columns brought to their declared type; values that do not parse become null."""
    key = F.col("o_orderkey")
    text = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderpriority",
        F.when(key % 7 == 0, F.lit("unknown")).otherwise(
            F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("ordered"),
        F.when(key % 5 == 0, F.lit("n/a")).otherwise(F.concat(key.cast("string"), F.lit(".5"))).alias("price"),
        F.when(F.col("o_orderstatus") == "F", F.lit("1")).when(F.col("o_orderstatus") == "O", F.lit("0"))
        .otherwise(F.lit("?")).alias("finished"))
    return readers.coerce(text, TEXT_ORDERS).withColumn("ordered", F.col("ordered").cast("timestamp_ntz"))


@register("history_scan", """
    SELECT event_id, user_id, ts, value FROM events
    WHERE ts <= TIMESTAMP '2024-01-20' AND ts >= TIMESTAMP '2024-01-13'""")
def history_scan(spark, folder):
    """Rows at or before a time and inside the longest window; both bounds reach the Parquet scan."""
    week = 7 * 86_400_000_000
    return readers.recent(table(spark, folder, "events"), "ts", "2024-01-20", week).select(
        "event_id", "user_id", "ts", "value")


@register("entity_history", """
    SELECT event_id, ts, value FROM events WHERE user_id = 7 AND ts <= TIMESTAMP '2024-01-25'""")
def entity_history(spark, folder):
    """One entity up to a time."""
    rows = readers.recent(table(spark, folder, "events"), "ts", "2024-01-25", None)
    return flt.matching(rows, {"user_id": 7}).select("event_id", "ts", "value")


@register("record_features", """
    SELECT '__record__' AS customer, TIMESTAMP '2000-01-01' AS seen_at, c_custkey, c_acctbal AS c_acctbal_current,
           CAST(c_mktsegment = 'BUILDING' AS TINYINT) AS c_mktsegment__BUILDING,
           CAST(c_mktsegment = 'MACHINERY' AS TINYINT) AS c_mktsegment__MACHINERY FROM customer""")
def record_features(spark, folder):
    """Records without entity and time get placeholder keys; unknown categories become zeros."""
    spec = DatasetSpec("records", "Records", "customer", "seen_at")
    inputs = FeatureSpec.read("records", {
        "c_acctbal": {"transforms": ["current"]}, "c_mktsegment": {"transforms": ["categorical"]}})
    fitted = features.FittedFeatures({"c_mktsegment": ["BUILDING", "MACHINERY"]})
    rows = scoring.with_placeholder_keys(table(spark, folder, "customer"), spec)
    built, _ = features.build_features(rows, spec, inputs, fitted, keep=["c_custkey"])
    return built.withColumn("seen_at", F.col("seen_at").cast("timestamp_ntz"))


STAGES = FeatureSpec.read("lineitem", {
    "quantity": {"column": "l_quantity", "transforms": ["current"]},
    "discount": {"column": "l_discount", "transforms": ["current"]},
    "tax": {"column": "l_tax", "transforms": ["current"]},
})


@register("stage_projection", """
    SELECT l_linenumber, count(*) AS n, round(avg(l_quantity), 4) AS quantity, round(avg(l_discount), 4) AS discount
    FROM lineitem GROUP BY 1""")
def stage_projection(spark, folder):
    """An early stage sees fewer inputs of the same table; the later column is never read."""
    spec = DatasetSpec("lineitem", "Items", "l_orderkey")
    built, fitted = features.build_features(
        table(spark, folder, "lineitem"), spec, STAGES.only("quantity", "discount"), keep=["l_linenumber"])
    assert fitted.feature_names == ["l_quantity_current", "l_discount_current"]
    return rounded(built.groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.avg("l_quantity_current").alias("quantity"),
        F.avg("l_discount_current").alias("discount")))
