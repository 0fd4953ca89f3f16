"""Row-based series columns on daily sums per user."""

from pyspark.sql import functions as F

from tabwise.functions import layout as lay
from tabwise.operators import series as ops
from tabwise.queries.registry import register, rounded, steady, table

DAILY_SQL = """d AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, round(sum(value), 2) AS amount,
                     count(*) AS n, count(*) FILTER (event_type = 'error') AS errors,
                     CASE WHEN count(*) FILTER (event_type = 'error') > 1 THEN 'Constrained' ELSE 'None' END AS state
              FROM events GROUP BY 1, 2)"""
OVER = "PARTITION BY user_id ORDER BY day"


def daily(spark, folder):
    errors = F.count_if(F.col("event_type") == "error")
    return table(spark, folder, "events").groupBy(
        "user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    ).agg(
        steady(F.sum("value"), 2).alias("amount"), F.count(F.lit(1)).alias("n"), errors.alias("errors"),
        F.when(errors > 1, F.lit("Constrained")).otherwise(F.lit("None")).alias("state"),
    )


def base(spark, folder, *columns):
    return daily(spark, folder).select("user_id", "day", *columns)


LAGS_SQL = f"""
    WITH {DAILY_SQL} SELECT user_id, day, amount, lag(amount, 1, 0) OVER w AS amount_lag_1,
           lag(amount, 2, 0) OVER w AS amount_lag_2, lag(amount, 7, 0) OVER w AS amount_lag_7
    FROM d WINDOW w AS ({OVER})"""


@register("lags_cut", LAGS_SQL)
def lags_cut(spark, folder):
    """The same with every user in chunks of rows."""
    return ops.lags(base(spark, folder, "amount"), "user_id", "day", "amount", [1, 2, 7], default=0.0,
                    layout=lay.Layout(5 * lay.DAY), chunk_rows=8)


@register("lags", LAGS_SQL)
def lags(spark, folder):
    return ops.lags(base(spark, folder, "amount"), "user_id", "day", "amount", [1, 2, 7], default=0.0)


@register("forward_sum", f"""
    WITH {DAILY_SQL}, s AS (SELECT user_id, day, amount, count(*) OVER w AS c, sum(amount) OVER w AS t
        FROM d WINDOW w AS ({OVER} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
    SELECT user_id, day, amount, round(CASE WHEN c = 3 THEN t END, 4) AS amount_next_3_sum FROM s""")
def forward_sum(spark, folder):
    return rounded(ops.forward_sum(base(spark, folder, "amount"), "user_id", "day", "amount", 3))


@register("forward_any", f"""
    WITH {DAILY_SQL} SELECT user_id, day, coalesce(max(CAST(errors > 0 AS INTEGER)) OVER
        ({OVER} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0) AS error_soon FROM d""")
def forward_any(spark, folder):
    found = ops.forward_any(base(spark, folder, "errors"), "user_id", "day", F.col("errors") > 0, 2, "error_soon")
    return found.drop("errors")


@register("forward_risk", f"""
    WITH {DAILY_SQL}, s AS (SELECT user_id, day, min(amount) OVER ({OVER} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS low,
        max(CAST(state = 'Constrained' AS INTEGER)) OVER ({OVER} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS bad FROM d)
    SELECT user_id, day, CAST(coalesce(low < 5, false) OR coalesce(bad = 1, false) AS INTEGER) AS risk FROM s""")
def forward_risk(spark, folder):
    rows = base(spark, folder, "amount", "state")
    return ops.forward_risk(rows, "user_id", "day", "amount", 5.0, "state", "Constrained", 2, "risk").select(
        "user_id", "day", "risk"
    )


@register("trend_pct", f"""
    WITH {DAILY_SQL}, s AS (SELECT user_id, day, amount, avg(amount) OVER
        ({OVER} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS p FROM d)
    SELECT user_id, day, amount, round(CASE WHEN p IS NOT NULL THEN
           least(greatest((amount - p) / greatest(p, 1.0) * 100, -50.0), 100.0) END, 4) AS amount_trend_pct FROM s""")
def trend_pct(spark, folder):
    return rounded(ops.trend_percent(base(spark, folder, "amount"), "user_id", "day", "amount"))


@register("time_to_next_event", """
    SELECT event_id, user_id, ts, round(coalesce((min(CASE WHEN event_type = 'purchase' THEN epoch_us(ts) END) OVER
        (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - epoch_us(ts))
        / 3600000000.0, 9999), 4) AS hours_to_event
    FROM events""")
def time_to_next_event(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    return rounded(ops.time_to_next_event(events, "user_id", "ts", F.col("event_type") == "purchase")).drop("event_type")


@register("coverage", """
    SELECT o_custkey, round(sum(o_totalprice) / greatest(count(*) * 1000.0, 1.0), 2) AS coverage FROM orders GROUP BY 1""")
def coverage(spark, folder):
    sums = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n")
    )
    return rounded(sums.select("o_custkey", ops.coverage("total", F.col("n") * 1000.0, None).alias("coverage")), 2)


@register("rule_label", """
    SELECT driver, count(*) AS n, count(*) FILTER (flagged = 1) AS flagged FROM (
        SELECT CASE WHEN l_discount > 0.08 THEN 'discount' WHEN l_quantity > 45 THEN 'volume'
                    WHEN l_tax > 0.07 THEN 'tax' ELSE 'none' END AS driver,
               CAST(l_quantity > 30 AND l_returnflag = 'R' AS INTEGER) AS flagged FROM lineitem) GROUP BY 1""")
def rule_label(spark, folder):
    rules = {"discount": F.col("l_discount") > 0.08, "volume": F.col("l_quantity") > 45, "tax": F.col("l_tax") > 0.07}
    rows = table(spark, folder, "lineitem").select(
        ops.rule_label(rules, "none").alias("driver"),
        ((F.col("l_quantity") > 30) & (F.col("l_returnflag") == "R")).cast("int").alias("flagged"),
    )
    return rows.groupBy("driver").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("flagged") == 1).alias("flagged"))


@register("composite_key", """
    SELECT l_suppkey || '__' || l_returnflag AS series_id, count(*) AS n, round(sum(l_quantity), 4) AS quantity
    FROM lineitem GROUP BY 1""")
def composite_key(spark, folder):
    items = table(spark, folder, "lineitem").withColumn("series_id", ops.composite_key(
        F.col("l_suppkey").cast("string"), "l_returnflag"))
    return rounded(items.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")))


@register("union_relaxed", """
    SELECT kind, count(*) AS n, count(nation) AS with_nation, round(sum(balance), 4) AS balance FROM (
        SELECT 'customer' AS kind, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL
        SELECT 'supplier', NULL, s_acctbal FROM supplier) GROUP BY 1""")
def union_relaxed(spark, folder):
    """Stacking tables whose columns differ; the absent column is null."""
    from tabwise.sources.readers import union_all

    a = table(spark, folder, "customer").select(
        F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    b = table(spark, folder, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance"))
    return rounded(union_all(a, b).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count("nation").alias("with_nation"), F.sum("balance").alias("balance")))
