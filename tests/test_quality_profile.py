import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwise.operators import profile, quality
from tabwise.plans.specs import DatasetSpec, SearchSpec

SPEC = DatasetSpec.read({
    "dataset_id": "s", "entity_key": "machine_id", "time_key": "timestamp",
    "columns": {"machine_id": {"type": "categorical", "role": "identifier"}, "timestamp": {"type": "timestamp"},
                "kind": {"type": "categorical"}, "value": {"type": "numeric"}, "failure": {"type": "boolean", "role": "event"}},
})


def findings(df, spec=SPEC):
    return {(r.check, r.column, r.severity): r.n_violations for r in quality.validate(df, spec).collect()}


def test_missing_column_is_invalid_and_ends_the_checks(spark):
    df = spark.createDataFrame([("A", "2026-01-01")], "machine_id string, timestamp string")
    found = findings(df)
    assert {c for _, c, _ in found} == {"kind", "value", "failure"}
    with pytest.raises(ValueError, match="kind.*value.*failure"):
        quality.raise_on_errors(quality.validate(df, SPEC))


def test_wrong_types_null_entities_and_duplicates(sensors):
    bad = sensors.withColumn("value", F.col("value").cast("string"))
    assert ("column_type", "value", "error") in findings(bad)
    none = sensors.withColumn("machine_id", F.when(F.col("row_id") % 10 != 0, F.col("machine_id")))
    assert findings(none)[("entity_null", "machine_id", "error")] == 72
    frame = sensors.toPandas()
    groups = frame.groupby(["machine_id", "timestamp"]).size()
    assert findings(sensors) == {("duplicate_keys", "machine_id", "warning"): int((groups > 1).sum())}


def test_profile_matches_pandas(sensors):
    frame = sensors.toPandas()
    rows = {r["column"]: r for r in profile.profile(sensors, SPEC).collect()}
    v, x = rows["value"], np.sort(frame["value"].dropna().to_numpy())
    assert (v.null_count, v.unique_count) == (int(frame["value"].isna().sum()), frame["value"].nunique(dropna=False))
    assert (v["min"], v["max"], v["mean"], v["std"], v["median"]) == pytest.approx(
        (x[0], x[-1], x.mean(), x.std(ddof=1), np.median(x)))
    assert v.p25 == x[int(np.floor((len(x) - 1) * 0.25 + 0.5))] and v.p75 == x[int(np.floor((len(x) - 1) * 0.75 + 0.5))]
    top = [(e.value, e.n) for e in rows["kind"].top_values]
    counts = frame["kind"].value_counts()
    assert dict(top) == counts.to_dict() and [n for _, n in top] == sorted(counts, reverse=True)
    spread = {(r["column"], r["value"]): r["n"] for r in profile.distribution(sensors, SPEC).collect()}
    assert spread[("failure", "1")] == int(frame["failure"].sum())
    seen = profile.overview(sensors, SPEC).first()
    assert (seen.row_count, seen.column_count, seen.entity_count) == (720, 6, 6)
    assert seen.time_start.startswith("2024-01-01")


def test_approximate_counts_are_close(sensors):
    exact = {r["column"]: r for r in profile.column_counts(sensors, SPEC).collect()}
    for r in profile.approx_column_counts(sensors, SPEC).collect():
        assert r["null_count"] == exact[r["column"]]["null_count"]
        assert r["unique_count"] == pytest.approx(exact[r["column"]]["unique_count"], rel=0.15)


def test_null_bucket(spark):
    df = spark.createDataFrame([(1,), (None,), (None,)], "failure int")
    rows = profile.distribution(df, DatasetSpec.read({
        "dataset_id": "x", "entity_key": "failure", "columns": {"failure": {"type": "boolean"}}})).collect()
    assert {(r.value, r.n) for r in rows} == {("1", 1), ("None", 2)}


def test_contract(catalogue):
    spec = DatasetSpec.read({"dataset_id": "c", "entity_key": "bike", "columns": {
        "bike": {"type": "categorical"}, "kind": {"type": "categorical"}, "weight": {"type": "numeric"}}})
    search = SearchSpec.read({
        "searchable_fields": {"sort": {"field": "kind"},
                              "mass": {"field": "weight", "operators": ["gte"], "unit": "kg", "aliases": ["kilos"]}},
        "semantic_filters": {"heavy": {"type": "expands_to", "expands_to": [{"field": "mass", "op": "gte", "value": 30}]}}})
    rows = {r.name: r for r in profile.search_contract(catalogue, spec, search).collect()}
    assert set(rows["sort"].categorical_values) == {"cargo", "city", "fold", "race"} and rows["sort"]["min"] is None
    assert (rows["mass"]["min"], rows["mass"]["max"], rows["mass"].aliases) == (7.0, 38.0, ["kilos"])
    assert profile.semantic_contract(catalogue, search).first().name == "heavy"
    with pytest.raises(ValueError, match="no search section"):
        profile.search_contract(catalogue, spec, None)


def test_whole_numbers_are_counted_by_bitmaps(spark):
    spec = DatasetSpec.read({"dataset_id": "d", "entity_key": "near", "columns": {
        c: {"type": "numeric"} for c in ("near", "far", "part", "none")}})
    rows = [(k % 700 - 300, k * 10**14, None if k % 5 == 0 else k // 3, None) for k in range(3000)]
    df = spark.createDataFrame(rows, "near int, far long, part long, none short").repartition(4)
    assert profile.dense_integers(df, ["near", "far", "part", "none"]) == ["near", "part"]
    got = {r["column"]: (r.null_count, r.unique_count) for r in profile.column_counts(df, spec).collect()}
    want = {c: (sum(r[i] is None for r in rows), len({r[i] for r in rows})) for i, c in enumerate(("near", "far", "part", "none"))}
    assert got == want
    whole = {r["column"]: (r.null_count, r.unique_count) for r in profile.profile(df, spec).collect()}
    assert whole == want
    # Distinct values do not travel: one bitmap per 32,768 of them does.
    key = spark.range(200_000).select(F.col("id").alias("near"))
    plan = profile.column_counts(key, spec, ["near"])._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" in plan and "hashpartitioning(column" in plan
    assert profile.column_counts(key, spec, ["near"]).first()["unique_count"] == 200_000
