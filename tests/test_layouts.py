"""Every layout gives the same rows and the same schema, whatever is null."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tabwise.functions import layout as lay
from tabwise.operators import dense_windows, features, joins, series
from tabwise.plans.specs import DatasetSpec, FeatureSpec

DATASET = DatasetSpec.read({"dataset_id": "s", "entity_key": "machine", "time_key": "time", "columns": {
    "machine": {"type": "categorical"}, "time": {"type": "timestamp"}, "count": {"type": "numeric"},
    "level": {"type": "numeric"}}})
SPEC = FeatureSpec.read("s", {
    "count": {"transforms": ["current", *[{op: {"windows": ["6h"]}} for op in ("mean", "min", "max", "median", "delta")]]},
    "hit": {"transforms": [{op: {"windows": ["6h"]}} for op in ("std", "slope")]},
    "level": {"transforms": [{op: {"windows": ["3h", "6h"]}} for op in ("mean", "min", "max", "delta")]},
    "clock": {"column": "time", "transforms": ["elapsed_time"]}})
CUT = lay.Layout(3_600_000_000 * 6, 60)
LAYOUTS = {"whole": (lay.WHOLE, None), "cut": (CUT, None), "dense": (lay.Layout(None, 10**6), 1), "dense-cut": (CUT, 1)}


@pytest.fixture(scope="module")
def rows(spark):
    start, out = datetime(2024, 5, 1), []
    for k in range(90):
        machine = (None, "a", "a", "b")[k % 4]
        time = None if k % 13 == 0 else start + timedelta(minutes=25 * k)
        count = None if k % 11 == 0 else 2**53 + 1 + (7 * k) % 40
        level = float("nan") if k == 50 else None if k % 7 == 0 else (k * 37 % 23) / 4
        out.append((k, machine, time, count, level, int(k % 9 == 0)))
    return spark.createDataFrame(out, "id long, machine string, time timestamp_ntz, count long, level double, hit int").cache()


def held(df, key="id"):
    return {r[key]: [("nan" if v != v else round(v, 6)) if isinstance(v, float) else v for v in r] for r in df.collect()}


@pytest.mark.parametrize("name", [n for n in LAYOUTS if n != "whole"])
def test_features_are_the_same_in_every_layout(rows, monkeypatch, name):
    want, _ = features.build_features(rows, DATASET, SPEC, keep=["id"], layout=lay.WHOLE)
    layout, limit = LAYOUTS[name]
    if limit:
        monkeypatch.setattr(dense_windows.choose, "__defaults__", (limit,))
        monkeypatch.setattr(dense_windows.attach, "__defaults__", (limit, 7))
        monkeypatch.setattr(dense_windows.dense_entities, "__defaults__", (limit,))
    got, _ = features.build_features(rows, DATASET, SPEC, keep=["id"], layout=layout)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
    a, b = held(got), held(want)
    assert a.keys() == b.keys() == set(range(90))
    for key in b:
        for column, x, y in zip(want.columns, a[key], b[key]):
            assert x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-6 * max(1, abs(y)), (key, column, x, y)


@pytest.mark.parametrize("make", [
    lambda df, layout: series.lags(df, "machine", "time", "count", [1, 2], ties=["id"], layout=layout, chunk_rows=9),
    lambda df, layout: series.forward_sum(df, "machine", "time", "hit", 3, ties=["id"], layout=layout, chunk_rows=9),
    lambda df, layout: series.forward_any(df, "machine", "time", F.col("hit") == 1, 4, "soon", ties=["id"], layout=layout, chunk_rows=9),
    lambda df, layout: series.trend_percent(df, "machine", "time", "hit", ties=["id"], layout=layout, chunk_rows=9),
], ids=["lags", "forward_sum", "forward_any", "trend"])
def test_series_are_the_same_in_every_layout(rows, make):
    want, got = make(rows, lay.WHOLE), make(rows, CUT)
    assert got.schema == want.schema and held(got) == held(want)


def test_time_to_event_keeps_every_row(rows):
    for layout in (lay.WHOLE, CUT):
        got = series.time_to_next_event(rows, "machine", "time", F.col("hit") == 1, layout=layout)
        assert set(held(got)) == set(range(90))


def test_narrowing_stops_at_one_crowded_time(spark):
    crowded = spark.range(2000).select(F.lit("a").alias("e"), F.lit(5_000_000).cast("long").alias("us"))
    plan = lay.measure(crowded, ["e"], F.col("us"), task_rows=10)
    assert not plan.whole and plan.bucket(F.col("us")) is not None
