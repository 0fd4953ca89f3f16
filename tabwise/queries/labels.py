"""Encodings, labels and time-aware joins."""

from pyspark.sql import functions as F

from tabwise.operators import encoding, joins, splits, targets
from tabwise.plans.specs import DatasetSpec, TargetSpec
from tabwise.queries.registry import register, rounded, table

EVENTS = DatasetSpec("events", "Events", "user_id", "ts")
# The event types of the events table, in the order of the SQL columns.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
HOUR = 3_600_000_000


@register("category_counts", """
    WITH r AS (SELECT event_type, row_number() OVER (ORDER BY ts, md5(concat_ws('|', user_id, '#42'))) AS i,
                      count(*) OVER () AS n FROM events)
    SELECT event_type AS category, count(*) AS n FROM r WHERE i <= floor(n * 0.7::DOUBLE) GROUP BY 1
    HAVING count(*) >= 2""")
def category_counts(spark, folder):
    """Categories learned on the oldest 70 percent only."""
    split = splits.assign_split(table(spark, folder, "events"), "user_id", "ts", (0.7, 0.3, 0.0))
    return encoding.category_counts(split.where(F.col("split") == "train"), "event_type", 2)


@register("onehot", "SELECT event_id, " + ", ".join(
    f"CAST(event_type = '{t}' AS TINYINT) AS event_type__{t}" for t in EVENT_TYPES) + " FROM events")
def onehot(spark, folder):
    events = table(spark, folder, "events")
    split = splits.assign_split(events, "user_id", "ts", (0.7, 0.3, 0.0))
    fitted = encoding.fit_categories(split.where(F.col("split") == "train"), {"event_type": 1})
    columns = encoding.onehot("event_type", fitted["event_type"])
    return events.select("event_id", *[value.alias(name) for name, value in columns])


@register("impute_median", """
    WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 10 THEN l_quantity END AS q,
                      CASE WHEN l_discount > 0.03 THEN l_discount END AS d FROM lineitem),
         f AS (SELECT coalesce(q, (SELECT median(q) FROM x)) AS q, coalesce(d, (SELECT median(d) FROM x)) AS d,
                      l_linenumber FROM x)
    SELECT l_linenumber, count(*) AS n, round(sum(q), 4) AS quantity, round(sum(d), 4) AS discount FROM f GROUP BY 1""")
def impute_median(spark, folder):
    items = table(spark, folder, "lineitem").select(
        "l_linenumber", F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("q"),
        F.when(F.col("l_discount") > 0.03, F.col("l_discount")).alias("d"),
    )
    filled = encoding.impute(items, encoding.fit_medians(items, ["q", "d"]))
    return rounded(filled.groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.sum("q").alias("quantity"), F.sum("d").alias("discount")
    ))


@register("standard_scale", """
    SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer))
           / (SELECT stddev_pop(c_acctbal) FROM customer), 4) AS scaled FROM customer""")
def standard_scale(spark, folder):
    customers = table(spark, folder, "customer")
    fitted = encoding.fit_scaling(customers, ["c_acctbal"])
    return rounded(customers.select("c_custkey", encoding.scaled("c_acctbal", fitted["c_acctbal"]).alias("scaled")))


@register("target_binary", """
    SELECT event_id, user_id, ts, CAST(event_type = 'purchase' AS TINYINT) AS bought FROM events""")
def target_binary(spark, folder):
    spec = TargetSpec("bought", "binary", "event_type", positive_class="purchase")
    return targets.select_target(table(spark, folder, "events"), spec, EVENTS, ["event_id"])


@register("target_regression", "SELECT event_id, user_id, ts, CAST(value AS DOUBLE) AS amount FROM events")
def target_regression(spark, folder):
    spec = TargetSpec("amount", "regression", "value")
    return targets.select_target(table(spark, folder, "events"), spec, EVENTS, ["event_id"])


@register("target_future_event", """
    SELECT event_id, user_id, ts, CAST(coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER
           (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 1 FOLLOWING AND 86400000000 FOLLOWING), 0)
           AS TINYINT) AS purchase_24h FROM events""")
def target_future_event(spark, folder):
    spec = TargetSpec("purchase_24h", "future_event", "event_type", "24h", "purchase")
    return targets.select_target(table(spark, folder, "events"), spec, EVENTS, ["event_id"])


@register("interval_join", f"""
    SELECT c.event_id, c.user_id, min(e.ts) AS first_error, count(e.ts) > 0 AS has_error
    FROM events c LEFT JOIN events e ON e.event_type = 'error' AND e.user_id = c.user_id AND e.ts > c.ts
         AND epoch_us(e.ts) <= epoch_us(c.ts) + {6 * HOUR}
    WHERE c.event_type = 'click' GROUP BY 1, 2""")
def interval_join(spark, folder):
    """Clicks with the first error of the same user within the next six hours."""
    events = table(spark, folder, "events")
    clicks = events.where(F.col("event_type") == "click").select("event_id", "user_id", "ts")
    errors = events.where(F.col("event_type") == "error").select("user_id", "ts")
    found = joins.first_within(clicks, errors, "user_id", "ts", "ts", 6 * HOUR, "first_error", "has_error")
    return found.select("event_id", "user_id", F.col("first_error").cast("timestamp_ntz").alias("first_error"), "has_error")


@register("asof_lookup", """
    SELECT e.event_id, e.user_id, e.ts, c.event_id AS click_id, c.value AS click_value, c.ts AS click_ts
    FROM (SELECT * FROM events WHERE event_type = 'error') e
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON e.user_id = c.user_id AND e.ts >= c.ts""")
def asof_lookup(spark, folder):
    """For every error, the user's last click at or before it."""
    events = table(spark, folder, "events")
    errors = events.where(F.col("event_type") == "error").select("event_id", "user_id", "ts")
    clicks = events.where(F.col("event_type") == "click").select(
        "user_id", F.col("event_id").alias("click_id"), F.col("value").alias("click_value"), F.col("ts").alias("click_ts")
    )
    return joins.as_of_join(errors, clicks, "user_id", "ts", "click_ts")


@register("latest_per_entity", """
    SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events
    WHERE ts <= TIMESTAMP '2024-01-15' AND ts >= TIMESTAMP '2024-01-08' GROUP BY 1""")
def latest_per_entity(spark, folder):
    events = table(spark, folder, "events").select("user_id", "ts", "event_id", "value")
    return joins.latest_per_entity(events, "user_id", "ts", "2024-01-15", 7 * 24 * HOUR)


@register("max_time", "SELECT min(o_orderdate) AS earliest, max(o_orderdate) AS latest FROM orders")
def max_time(spark, folder):
    from tabwise.operators.profile import time_span

    return time_span(table(spark, folder, "orders"), "o_orderdate").select("earliest", "latest")


@register("attach_label", """
    SELECT lang, count(*) AS n, count(quality) AS labelled, CAST(sum(quality) AS BIGINT) AS good
    FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id) GROUP BY 1""")
def attach_label(spark, folder):
    """Features joined with labels kept in another table; unlabelled rows stay."""
    joined = joins.attach_label(
        table(spark, folder, "documents").select("doc_id", "lang"), table(spark, folder, "labels"), ["doc_id"]
    )
    return joined.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count("quality").alias("labelled"), F.sum("quality").alias("good")
    )


@register("dimension_lookup", """
    SELECT n_name, count(*) AS n, round(sum(c_acctbal), 4) AS balance FROM customer
    LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def dimension_lookup(spark, folder):
    nations = table(spark, folder, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    named = joins.lookup(table(spark, folder, "customer"), nations, "c_nationkey", ["n_name"])
    return rounded(named.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("balance")))
