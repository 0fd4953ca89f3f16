"""Slices, aggregation, comparison, slice discovery."""

from pyspark.sql import functions as F

from tabwise.operators import analysis as ops
from tabwise.operators import slices
from tabwise.queries.registry import register, rounded, table

FLAGS = ["l_returnflag", "l_linestatus"]


@register("slice_mean", """
    SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS l_extendedprice_mean, count(*) AS row_count
    FROM lineitem GROUP BY ALL""")
def slice_mean(spark, folder):
    return rounded(ops.slice_by(table(spark, folder, "lineitem"), FLAGS, "l_extendedprice", "mean"))


@register("slice_median", """
    SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 4) AS l_extendedprice_median, count(*) AS row_count
    FROM lineitem GROUP BY ALL""")
def slice_median(spark, folder):
    return rounded(ops.slice_by(table(spark, folder, "lineitem"), FLAGS, "l_extendedprice", "median"))


@register("slice_std", """
    SELECT l_suppkey, round(stddev_samp(l_discount), 4) AS l_discount_std, count(*) AS row_count
    FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL""")
def slice_std(spark, folder):
    return rounded(ops.slice_by(
        table(spark, folder, "lineitem"), ["l_suppkey"], "l_discount", "std", {"l_returnflag": ["A", "R"]}
    ))


@register("slice_sum", """
    SELECT l_suppkey, l_linestatus, round(sum(l_quantity), 4) AS l_quantity_sum, count(*) AS row_count
    FROM lineitem GROUP BY ALL ORDER BY l_quantity_sum DESC NULLS FIRST, l_suppkey, l_linestatus LIMIT 15""")
def slice_sum(spark, folder):
    return rounded(ops.slice_by(
        table(spark, folder, "lineitem"), ["l_suppkey", "l_linestatus"], "l_quantity", "sum",
        order_by="l_quantity_sum", limit=15,
    ))


@register("slice_count", """
    SELECT event_type, count(nullif(value, 0)) AS value_count, count(*) AS row_count
    FROM events GROUP BY ALL""")
def slice_count(spark, folder):
    events = table(spark, folder, "events").withColumn("value", F.nullif("value", F.lit(0.0)))
    return ops.slice_by(events, ["event_type"], "value", "count")


@register("slice_min_max", """
    SELECT o_orderpriority, o_orderstatus, min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max
    FROM orders GROUP BY ALL""")
def slice_min_max(spark, folder):
    orders = table(spark, folder, "orders")
    keys = ["o_orderpriority", "o_orderstatus"]
    low = ops.slice_by(orders, keys, "o_totalprice", "min").drop("row_count")
    return low.join(ops.slice_by(orders, keys, "o_totalprice", "max").drop("row_count"), keys)


@register("aggregate_multi", """
    SELECT o_orderpriority, round(avg(o_totalprice), 4) AS o_totalprice_mean, count(o_custkey) AS o_custkey_count,
           max(o_orderkey) AS o_orderkey_max
    FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL""")
def aggregate_multi(spark, folder):
    return rounded(ops.aggregate_by(
        table(spark, folder, "orders"), ["o_orderpriority"],
        {"o_totalprice": "mean", "o_custkey": "count", "o_orderkey": "max"}, {"o_orderstatus": "F"},
    ))


@register("compare_dimension", """
    WITH o AS (SELECT avg(c_acctbal) AS overall FROM customer),
         g AS (SELECT c_mktsegment, avg(c_acctbal) AS m, count(*) AS row_count FROM customer GROUP BY 1)
    SELECT c_mktsegment, round(m, 4) AS c_acctbal_mean, row_count, round(overall, 4) AS overall,
           round((m - overall) / (abs(overall) + 1e-12), 4) AS relative_diff FROM g, o""")
def compare_dimension(spark, folder):
    return rounded(ops.compare(table(spark, folder, "customer"), "c_mktsegment", "c_acctbal"))


@register("compare_median", """
    WITH o AS (SELECT median(l_quantity) AS overall FROM lineitem WHERE l_linestatus = 'O'),
         g AS (SELECT l_suppkey, median(l_quantity) AS m, count(*) AS row_count FROM lineitem
               WHERE l_linestatus = 'O' GROUP BY 1)
    SELECT l_suppkey, round(m, 4) AS l_quantity_median, row_count, round(overall, 4) AS overall,
           round((m - overall) / (abs(overall) + 1e-12), 4) AS relative_diff FROM g, o""")
def compare_median(spark, folder):
    return rounded(ops.compare(
        table(spark, folder, "lineitem"), "l_suppkey", "l_quantity", "median", {"l_linestatus": "O"}
    ))


def fact_rows(spark, folder):
    """Line items with their order and part attributes; Spark broadcasts a side only if its size allows."""
    items = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", *FLAGS
    )
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return items.join(orders, "l_orderkey").join(parts, "l_partkey")


DIMS = [*FLAGS, "o_orderpriority", "p_type"]

SLICE_SQL = """
    WITH f AS ({rows}),
    o AS (SELECT {agg}(x) AS overall FROM f),
    g AS (
        SELECT grouping(l_returnflag, l_linestatus, o_orderpriority, p_type) AS set_id,
               4 - bit_count(grouping(l_returnflag, l_linestatus, o_orderpriority, p_type)) AS n_dimensions,
               concat_ws(',', CASE WHEN grouping(l_returnflag) = 0 THEN 'l_returnflag=' || l_returnflag END,
                              CASE WHEN grouping(l_linestatus) = 0 THEN 'l_linestatus=' || l_linestatus END,
                              CASE WHEN grouping(o_orderpriority) = 0 THEN 'o_orderpriority=' || o_orderpriority END,
                              CASE WHEN grouping(p_type) = 0 THEN 'p_type=' || p_type END) AS slice,
               count(*) AS row_count, {agg}(x) AS m, median(x) AS med, stddev_samp(x) AS sd
        FROM f GROUP BY CUBE (l_returnflag, l_linestatus, o_orderpriority, p_type))
    SELECT slice, CAST(n_dimensions AS INTEGER) AS n_dimensions, row_count, round(m, 4) AS metric_value,
           round(med, 4) AS metric_median, round(sd, 4) AS metric_std, round(overall, 4) AS overall_baseline,
           round(m - overall, 4) AS difference, round(abs(m - overall), 4) AS abs_difference
    FROM g, o WHERE n_dimensions BETWEEN 1 AND 3 AND row_count >= {least} AND m IS NOT NULL
    ORDER BY abs(m - overall) DESC, n_dimensions, set_id DESC LIMIT 20"""
FACT_SQL = """SELECT l_returnflag, l_linestatus, o_orderpriority, p_type, {x} AS x FROM lineitem
        JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey"""


def flat(df):
    """Slices with their values as one text, so that every column is scalar."""
    named = F.concat_ws(",", F.transform("dimensions", lambda d: F.concat(d, F.lit("="), F.col("values")[d])))
    return rounded(df.select(
        named.alias("slice"), F.col("n_dimensions").cast("int").alias("n_dimensions"), "row_count", "metric_value",
        "metric_median", "metric_std", "overall_baseline", "difference", "abs_difference",
    ))


@register("interesting_slices", SLICE_SQL.format(rows=FACT_SQL.format(x="l_extendedprice"), agg="avg", least=100))
def interesting_slices(spark, folder):
    return flat(slices.interesting_slices(fact_rows(spark, folder), "l_extendedprice", DIMS))


@register("interesting_slices_median", SLICE_SQL.format(rows=FACT_SQL.format(x="l_extendedprice"), agg="median", least=50))
def interesting_slices_median(spark, folder):
    return flat(slices.interesting_slices(fact_rows(spark, folder), "l_extendedprice", DIMS, 50, aggregation="median"))


@register("interesting_slices_std", SLICE_SQL.format(rows=FACT_SQL.format(x="l_extendedprice"), agg="stddev_samp", least=60))
def interesting_slices_std(spark, folder):
    return flat(slices.interesting_slices(fact_rows(spark, folder), "l_extendedprice", DIMS, 60, aggregation="std"))
