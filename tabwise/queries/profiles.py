"""Validation and profiling."""

from pyspark.sql import functions as F

from tabwise.operators import profile as ops
from tabwise.operators import quality
from tabwise.plans.specs import DatasetSpec, SearchSpec
from tabwise.queries.registry import register, rounded, table

LINEITEM = DatasetSpec.read({
    "dataset_id": "lineitem", "entity_key": "l_suppkey", "time_key": "l_shipdate",
    "columns": {"l_suppkey": {"type": "numeric", "role": "identifier"}, "l_shipdate": {"type": "timestamp"},
                "l_quantity": {"type": "numeric"}, "l_returnflag": {"type": "categorical"}},
})
ORDERS = DatasetSpec.read({
    "dataset_id": "orders", "entity_key": "o_custkey", "time_key": "o_orderdate",
    "columns": {
        "o_orderkey": {"type": "numeric", "role": "identifier"}, "o_custkey": {"type": "numeric", "role": "identifier"},
        "o_orderstatus": {"type": "categorical"}, "o_totalprice": {"type": "numeric"},
        "o_orderdate": {"type": "timestamp"}, "o_orderpriority": {"type": "categorical"},
    },
})
EVENTS = DatasetSpec.read({
    "dataset_id": "events", "entity_key": "user_id", "time_key": "ts",
    "columns": {"user_id": {"type": "numeric", "role": "identifier"}, "ts": {"type": "timestamp"},
                "event_type": {"type": "categorical", "role": "event"}, "value": {"type": "numeric"}},
})
PART = DatasetSpec.read({
    "dataset_id": "part", "entity_key": "p_partkey",
    "columns": {"p_partkey": {"type": "numeric", "role": "identifier"}, "p_brand": {"type": "categorical"},
                "p_type": {"type": "categorical"}, "p_size": {"type": "numeric"}, "p_retailprice": {"type": "numeric"}},
})
PART_SEARCH = SearchSpec.read({"searchable_fields": {
    "brand": {"field": "p_brand"}, "kind": {"field": "p_type"},
    "size": {"field": "p_size", "operators": ["eq", "gte", "lte", "between"], "unit": "cm"},
    "price": {"field": "p_retailprice", "operators": ["gte", "lte", "between"], "unit": "USD"},
}})


@register("validate_nulls", "SELECT count(*) AS n_violations FROM (SELECT nullif(l_suppkey, 7) AS k FROM lineitem) WHERE k IS NULL")
def validate_nulls(spark, folder):
    items = table(spark, folder, "lineitem").withColumn("l_suppkey", F.nullif("l_suppkey", F.lit(7)))
    return quality.null_keys(items, "l_suppkey")


@register("validate_duplicates", """
    SELECT count(*) AS n_violations FROM
      (SELECT 1 FROM lineitem GROUP BY l_suppkey, l_shipdate HAVING count(*) > 1)""")
def validate_duplicates(spark, folder):
    return quality.duplicate_keys(table(spark, folder, "lineitem"), "l_suppkey", "l_shipdate")


@register("validate_report", """
    WITH d AS (SELECT count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_suppkey, l_shipdate HAVING count(*) > 1))
    SELECT 'duplicate_keys' AS "check", 'l_suppkey' AS "column", 'warning' AS severity, n AS n_violations FROM d WHERE n > 0""")
def validate_report(spark, folder):
    return quality.validate(table(spark, folder, "lineitem"), LINEITEM).drop("message")


@register("profile_overview", """
    SELECT count(*) AS row_count, 6 AS column_count, count(DISTINCT user_id) AS entity_count,
           strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS time_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS time_end
    FROM events""")
def profile_overview(spark, folder):
    seen = ops.overview(table(spark, folder, "events"), EVENTS)
    return seen.withColumns({c: F.substring(c, 1, 19) for c in ("time_start", "time_end")})


@register("profile_counts", """
    SELECT 'o_orderkey' AS "column", 0 AS null_count, count(DISTINCT o_orderkey) AS unique_count FROM orders UNION ALL
    SELECT 'o_custkey', 0, count(DISTINCT o_custkey) FROM orders UNION ALL
    SELECT 'o_orderstatus', count(*) FILTER (o_orderstatus = 'P'), count(DISTINCT o_orderstatus) FROM orders UNION ALL
    SELECT 'o_totalprice', 0, count(DISTINCT o_totalprice) FROM orders UNION ALL
    SELECT 'o_orderdate', 0, count(DISTINCT o_orderdate) FROM orders UNION ALL
    SELECT 'o_orderpriority', 0, count(DISTINCT o_orderpriority) FROM orders""")
def profile_counts(spark, folder):
    """Status P is made null, which then counts as one distinct value in its place."""
    orders = table(spark, folder, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return ops.column_counts(orders, ORDERS)


@register("profile_numeric", """
    WITH v AS (SELECT 'o_totalprice' AS "column", o_totalprice AS x FROM orders UNION ALL
               SELECT 'o_orderkey', o_orderkey FROM orders UNION ALL SELECT 'o_custkey', o_custkey FROM orders),
    r AS (SELECT "column", x, row_number() OVER (PARTITION BY "column" ORDER BY x) - 1 AS i,
                 count(*) OVER (PARTITION BY "column") AS n FROM v)
    SELECT "column", min(x) AS "min", max(x) AS "max", round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std,
           round(median(x), 4) AS median, max(x) FILTER (i = floor((n - 1) * 0.25 + 0.5)) AS p25,
           max(x) FILTER (i = floor((n - 1) * 0.75 + 0.5)) AS p75
    FROM r GROUP BY 1""")
def profile_numeric(spark, folder):
    """Median interpolates; p25 and p75 are the nearest element."""
    return rounded(ops.numeric_stats(table(spark, folder, "orders"), ORDERS))


@register("profile_categorical", """
    WITH c AS (SELECT 'p_brand' AS "column", p_brand AS "value", count(*) AS n FROM part GROUP BY 2 UNION ALL
               SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2)
    SELECT "column", "value", n,
           CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, "value") AS INTEGER) AS "position"
    FROM c QUALIFY "position" <= 10""")
def profile_categorical(spark, folder):
    return ops.top_values(table(spark, folder, "part"), PART)


@register("profile_distribution", """
    SELECT 'event_type' AS "column", event_type AS "value", count(*) AS n FROM events GROUP BY 2""")
def profile_distribution(spark, folder):
    return ops.distribution(table(spark, folder, "events"), EVENTS)


@register("search_contract", """
    WITH t AS (SELECT p_type, row_number() OVER (ORDER BY count(*) DESC, p_type) AS i FROM part GROUP BY 1),
         b AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS i FROM part GROUP BY 1)
    SELECT 'brand' AS name, 'p_brand' AS field, 'categorical' AS "type", 'eq,in' AS operators, NULL AS unit,
           NULL::DOUBLE AS "min", NULL::DOUBLE AS "max",
           (SELECT string_agg(p_brand, ',' ORDER BY i) FROM b WHERE i <= 10) AS categories
    UNION ALL SELECT 'kind', 'p_type', 'categorical', 'eq,in', NULL, NULL, NULL,
           (SELECT string_agg(p_type, ',' ORDER BY i) FROM t WHERE i <= 10)
    UNION ALL SELECT 'size', 'p_size', 'numeric', 'eq,gte,lte,between', 'cm', min(p_size), max(p_size), NULL FROM part
    UNION ALL SELECT 'price', 'p_retailprice', 'numeric', 'gte,lte,between', 'USD', min(p_retailprice),
           max(p_retailprice), NULL FROM part""")
def search_contract(spark, folder):
    found = ops.search_contract(table(spark, folder, "part"), PART, PART_SEARCH)
    return found.select(
        "name", "field", "type", F.concat_ws(",", "operators").alias("operators"), "unit", "min", "max",
        F.when(F.col("categorical_values").isNotNull(), F.concat_ws(",", "categorical_values")).alias("categories"),
    )
