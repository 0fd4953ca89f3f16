"""Parametric search over the catalogue-like tables."""

from pyspark.sql import functions as F

from tabwise.operators import search as ops
from tabwise.operators.filters import Filter
from tabwise.operators.search import Sort
from tabwise.plans.specs import DatasetSpec, SearchSpec
from tabwise.queries.registry import register, rounded, table


@register("search_eq_in_gte", """
    SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part
    WHERE p_type IN ('ECONOMY', 'PROMO') AND p_size >= 20 AND p_brand = 'Brand#7'
    ORDER BY p_retailprice DESC NULLS FIRST, p_partkey NULLS FIRST LIMIT 50""")
def search_eq_in_gte(spark, folder):
    filters = [
        Filter("p_type", "in", ["ECONOMY", "PROMO"]), Filter("p_size", "gte", 20), Filter("p_brand", "eq", "Brand#7"),
    ]
    return ops.search(
        table(spark, folder, "part"), filters, [Sort("p_retailprice", True)], 50,
        ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], tie_break=["p_partkey"],
    ).rows


@register("search_lte_between", """
    SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders
    WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_orderstatus = 'F' AND o_orderdate <= TIMESTAMP '1997-06-30'
    ORDER BY o_totalprice NULLS FIRST, o_orderkey LIMIT 1000""")
def search_lte_between(spark, folder):
    filters = [
        Filter("o_totalprice", "between", low=100000.0, high=200000.0), Filter("o_orderstatus", "eq", "F"),
        Filter("o_orderdate", "lte", __import__("datetime").datetime(1997, 6, 30)),
    ]
    return ops.search(
        table(spark, folder, "orders"), filters, [Sort("o_totalprice")], 5000,  # clamped to 1000
        ["o_orderkey", "o_totalprice", "o_orderpriority"], tie_break=["o_orderkey"],
    ).rows


BANDS = SearchSpec.read({
    "searchable_fields": {"brand": {"field": "p_brand", "aliases": ["make"]}},
    "semantic_filters": {
        "price_point": {"type": "range_contains", "min_field": "price_min", "max_field": "price_max"},
        "bulk": {"type": "expands_to", "expands_to": [
            {"field": "l_quantity", "op": "gte", "value": 40}, {"field": "l_discount", "op": "lte", "value": 0.02},
        ]},
    },
})


@register("search_contains_range", """
    WITH bands AS (SELECT p_brand, p_type, min(p_retailprice) AS price_min, max(p_retailprice) AS price_max
                   FROM part GROUP BY 1, 2)
    SELECT p_brand, p_type, price_min, price_max FROM bands WHERE price_min <= 905 AND price_max >= 905
    ORDER BY p_brand, p_type LIMIT 1000""")
def search_contains_range(spark, folder):
    bands = table(spark, folder, "part").groupBy("p_brand", "p_type").agg(
        F.min("p_retailprice").alias("price_min"), F.max("p_retailprice").alias("price_max")
    )
    return ops.search(
        bands, [Filter("price_point", "semantic", 905)], [Sort("p_brand"), Sort("p_type")], 1000, spec=BANDS
    ).rows


@register("search_semantic_expand", """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount FROM lineitem
    WHERE l_quantity >= 40 AND l_discount <= 0.02
    ORDER BY l_quantity DESC NULLS FIRST, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 200""")
def search_semantic_expand(spark, folder):
    return ops.search(
        table(spark, folder, "lineitem"), [Filter("bulk", "semantic")], [Sort("l_quantity", True)], 200,
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount"], BANDS,
        tie_break=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
    ).rows


@register("search_matched_count", """
    SELECT count(*) AS matched FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') AND p_size BETWEEN 10 AND 30""")
def search_matched_count(spark, folder):
    """The alias ``make`` stands for p_brand; matched rows are counted before the limit."""
    filters = [Filter("make", "in", ["Brand#1", "Brand#2"]), Filter("p_size", "between", low=10, high=30)]
    found = ops.search(table(spark, folder, "part"), filters, limit=1, spec=BANDS)
    return found.matching.agg(F.count(F.lit(1)).alias("matched"))


@register("sample_rows", """
    SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer
    WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey = 3
    ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 25""")
def sample_rows(spark, folder):
    return ops.sample_rows(
        table(spark, folder, "customer"), 25, {"c_mktsegment": ["BUILDING", "MACHINERY"], "c_nationkey": 3},
        ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"], "c_acctbal", True, ["c_custkey"],
    )


EVENTS_ROLES = DatasetSpec.read({
    "dataset_id": "events", "entity_key": "user_id", "time_key": "ts",
    "columns": {
        "user_id": {"type": "numeric", "role": "identifier"}, "ts": {"type": "timestamp", "role": "identifier"},
        "event_type": {"type": "categorical", "role": "event"}, "value": {"type": "numeric"},
        "props": {"type": "string", "role": "metadata"},
    },
})


@register("project_roles", """
    SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def project_roles(spark, folder):
    kept = ops.select_roles(table(spark, folder, "events"), EVENTS_ROLES, "identifier", "event", "feature")
    return rounded(kept.groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
    ))
