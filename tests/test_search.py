import pytest

from tabwise.operators import filters as flt
from tabwise.operators import search
from tabwise.operators.filters import Filter
from tabwise.operators.search import Sort
from tabwise.plans.specs import SearchSpec

SPEC = SearchSpec.read({
    "searchable_fields": {"mass": {"field": "weight", "aliases": ["kilos"]}},
    "semantic_filters": {
        "rider": {"type": "range_contains", "min_field": "shortest", "max_field": "tallest"},
        "hauler": {"type": "expands_to", "expands_to": [
            {"field": "load", "op": "gte", "value": 100}, {"field": "kind", "op": "in", "value": ["cargo", "city"]}]},
        "broken": {"type": "no such type"},
    },
})


def found(df, *filters):
    result = search.search(df, list(filters), spec=SPEC)
    names = sorted(r.bike for r in result.rows.collect())
    assert result.matched() == len(names)
    return " ".join(names)


def test_every_operator_selects_by_value(catalogue):
    assert found(catalogue, Filter("state", "eq", "gone")) == "finch"
    assert found(catalogue, Filter("gears", "in", [1, 22])) == "kite owl"
    assert found(catalogue, Filter("weight", "gte", 18)) == "heron owl wren"
    assert found(catalogue, Filter("weight", "lte", 12)) == "finch kite"
    assert found(catalogue, Filter("gears", "between", low=3, high=7)) == "finch tern wren"
    assert found(catalogue, Filter("any", "contains_range", 145, "shortest", "tallest")) == "finch"
    assert found(catalogue, Filter("load", "lte", 1000)) == "finch heron kite tern wren"  # unknown is no match


def test_aliases_and_named_meanings(catalogue):
    assert found(catalogue, Filter("kilos", "lte", 7)) == found(catalogue, Filter("mass", "lte", 7)) == "kite"
    tall = [Filter("rider", op, 193) for op in ("eq", "semantic")]
    assert [found(catalogue, f) for f in tall] == ["heron owl", "heron owl"]
    assert found(catalogue, Filter("hauler", "semantic")) == "heron tern wren"
    parts = search.search(catalogue, [Filter("hauler", "semantic")], spec=SPEC).applied
    assert [(p["field"], p["op"]) for p in parts] == [("load", "gte"), ("kind", "in")]


def test_all_filters_must_hold(catalogue):
    assert found(catalogue, Filter("kind", "eq", "cargo"), Filter("state", "eq", "sale"), Filter("gears", "lte", 5)) == "owl"
    assert found(catalogue, Filter("kind", "eq", "cargo"), Filter("weight", "lte", 5)) == ""


@pytest.mark.parametrize("arguments", [
    {"op": "gte"}, {"op": "between", "high": 4}, {"op": "in", "value": 7}, {"op": "about", "value": 7},
    {"op": "contains_range", "value": 7}])
def test_incomplete_filters_are_refused(arguments):
    with pytest.raises(ValueError):
        Filter("gears", **arguments)


@pytest.mark.parametrize("condition, message", [
    (Filter("sailor", "semantic", 1), "hauler"), (Filter("rider", "semantic"), "needs a value"),
    (Filter("broken", "semantic", 1), "unknown type"), (Filter("wheels", "eq", 2), "filter column")])
def test_unknown_names_are_refused(catalogue, condition, message):
    with pytest.raises(ValueError, match=message):
        found(catalogue, condition)


def test_order_columns_and_limit(catalogue):
    result = search.search(catalogue, [], [Sort("kind", True), Sort("weight")], 4, ["bike", "gears"])
    assert [tuple(r) for r in result.rows.collect()] == [("kite", 22), ("finch", 3), ("tern", 7), ("wren", 3)]
    assert result.matched() == 6
    assert [search.clamp_limit(n) for n in (-3, 17, 5000)] == [1, 17, 1000]
    for order in (False, True):
        assert search.search(catalogue, [], [Sort("load", order)]).rows.first().bike == "owl"  # null comes first
    with pytest.raises(ValueError, match="sort column"):
        search.search(catalogue, [], [Sort("wheels")])
    with pytest.raises(ValueError, match="columns"):
        search.search(catalogue, [], columns=["wheels"])


def test_plain_conditions(catalogue):
    rows = search.sample_rows(catalogue, 10, {"state": "sale", "gears": [1, 3]}, ["bike"])
    assert sorted(r.bike for r in rows.collect()) == ["owl", "wren"]


@pytest.mark.parametrize("count", [flt.INLINE_VALUES, flt.INLINE_VALUES + 1])
@pytest.mark.parametrize("make", [int, float])
def test_long_lists_change_neither_rows_nor_columns(spark, count, make):
    df = spark.createDataFrame([("a", 3.0), ("b", 4.5), ("c", float(count + 5)), ("d", None)], "k string, x double")
    kept = flt.apply(df, [Filter("x", "in", [make(v) for v in range(3, count + 3)])])
    assert kept.schema == df.schema and [tuple(r) for r in kept.collect()] == [("a", 3.0)]
    names = flt.apply(df, [Filter("k", "in", [f"n{v}" for v in range(count - 1)] + ["b"])])
    assert names.columns == df.columns and [r.k for r in names.collect()] == ["b"]


def test_filters_reach_the_scan(spark, catalogue, tmp_path):
    catalogue.write.parquet(f"{tmp_path}/bikes")
    stored = spark.read.parquet(f"{tmp_path}/bikes")
    plan = search.search(stored, [Filter("weight", "gte", 30)], columns=["bike"]).rows._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert "GreaterThanOrEqual(weight,30)" in text and "tallest" not in text.split("ReadSchema")[1]
