"""Attribution of a fixed linear model over order features."""

from pyspark.sql import functions as F

from tabwise.operators import encoding
from tabwise.operators import explain as ops
from tabwise.queries.registry import register, rounded, steady, table

# The model of these queries. The means are those of the table itself.
COEFFICIENTS = {"lines_current": 1.5, "quantity_current": -0.02, "discount_current": 30.0}
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
PRIORITY_WEIGHTS = {p: (i - 2) / 2 for i, p in enumerate(PRIORITIES)}

FEATURES_SQL = """x AS (SELECT l_orderkey, count(*)::DOUBLE AS lines_current, sum(l_quantity) AS quantity_current,
                    avg(l_discount) AS discount_current FROM lineitem GROUP BY 1),
    m AS (SELECT avg(lines_current) AS a, avg(quantity_current) AS b, avg(discount_current) AS c FROM x)"""
LONG_SQL = FEATURES_SQL + """,
    i AS (SELECT l_orderkey, 'lines_current' AS feature, lines_current AS "value", 1.5 * (lines_current - a) AS impact FROM x, m
          UNION ALL SELECT l_orderkey, 'quantity_current', quantity_current, -0.02 * (quantity_current - b) FROM x, m
          UNION ALL SELECT l_orderkey, 'discount_current', discount_current, 30.0 * (discount_current - c) FROM x, m)"""


def order_features(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("lines_current"), F.sum("l_quantity").alias("quantity_current"),
        F.avg("l_discount").alias("discount_current"))


def impacts(spark, folder):
    rows = order_features(spark, folder)
    means = rows.agg(*[F.avg(c).alias(c) for c in COEFFICIENTS]).first().asDict()
    return ops.linear_attribution(rows, ["l_orderkey"], COEFFICIENTS, means)


@register("linear_attribution", f"""
    WITH {LONG_SQL} SELECT l_orderkey, feature, round("value", 4) AS "value", round(impact, 4) AS impact FROM i""")
def linear_attribution(spark, folder):
    return rounded(impacts(spark, folder))


@register("top_drivers", f"""
    WITH {LONG_SQL}, r AS (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(impact, 9) DESC, feature) AS p,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY round(impact, 9), feature) AS n,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(round(impact, 9)) DESC, feature) AS a FROM i)
    SELECT l_orderkey, feature, round(impact, 4) AS impact, ranking, CAST(pos AS INTEGER) AS "position" FROM (
        SELECT *, 'positive' AS ranking, p AS pos FROM r WHERE round(impact, 9) > 0 UNION ALL
        SELECT *, 'negative', n FROM r WHERE round(impact, 9) < 0 UNION ALL
        SELECT *, 'absolute', a FROM r) WHERE pos <= 2""")
def top_drivers(spark, folder):
    rows = impacts(spark, folder).withColumn("impact", steady("impact", 9))
    return rounded(ops.top_drivers(rows, ["l_orderkey"], 2).drop("value"))


@register("group_onehot", """
    SELECT o_orderkey, 'o_orderpriority' AS feature, o_orderpriority AS "value",
           CAST(CASE o_orderpriority WHEN '1-URGENT' THEN -1.0 WHEN '2-HIGH' THEN -0.5 WHEN '3-MEDIUM' THEN 0.0
                WHEN '4-NOT SPECIFIED' THEN 0.5 WHEN '5-LOW' THEN 1.0 END AS DOUBLE) AS impact FROM orders
    UNION ALL SELECT o_orderkey, 'o_custkey', CAST(o_custkey::DOUBLE AS VARCHAR), round(CAST(o_custkey AS DOUBLE) * 0.001::DOUBLE, 4) FROM orders""")
def group_onehot(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    encoded = orders.select(
        "o_orderkey", F.col("o_custkey").cast("double").alias("o_custkey_current"),
        *[value.alias(name) for name, value in encoding.onehot("o_orderpriority", PRIORITIES)])
    weights = {f"o_orderpriority__{p}": w for p, w in PRIORITY_WEIGHTS.items()} | {"o_custkey_current": 0.001}
    long = ops.linear_attribution(encoded, ["o_orderkey"], weights, dict.fromkeys(weights, 0.0))
    return rounded(ops.group_onehot(long, ["o_orderkey"]).drop("categories"))
