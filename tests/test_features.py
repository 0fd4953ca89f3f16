from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwise.functions import layout as lay
from tabwise.operators import dense_windows, encoding, features
from tabwise.plans import durations
from tabwise.plans.specs import DatasetSpec, FeatureSpec

SPEC = DatasetSpec("s", "S", "machine_id", "timestamp")
WINDOWS = ["1h", "6h", "1d"]
OPS = ["mean", "min", "max", "std", "median", "slope", "delta"]
ALL = FeatureSpec.read("s", {"value": {"transforms": [
    "current", "elapsed_time", "hour_of_day", "day_of_week", *[{op: {"windows": WINDOWS}} for op in OPS]]}})


def built(df, spec=ALL, layout=None, keep=("row_id",), fitted=None):
    out, _ = features.build_features(df, SPEC, spec, fitted, keep, layout)
    return out.toPandas().sort_values("row_id").reset_index(drop=True)


def brute(frame):
    """Windows straight from the definition: rows of the entity with time in (t - w, t]."""
    us = frame["timestamp"].astype("datetime64[us]").astype("int64").to_numpy()
    out = {}
    for w in WINDOWS:
        span = durations.micros(w)
        rows = {op: [] for op in OPS}
        for e, t, y in zip(frame["machine_id"], us, frame["value"]):
            inside = ((frame["machine_id"] == e) & (us > t - span) & (us <= t)).to_numpy()
            v = frame["value"].to_numpy()[inside]
            first = us[(frame["machine_id"] == e).to_numpy()].min()
            s = ((us[inside] - first) // 1_000_000).astype(float)
            ok = ~np.isnan(v)
            x = v[ok]
            none = len(x) == 0
            rows["mean"].append(np.nan if none else x.mean())
            rows["min"].append(np.nan if none else x.min())
            rows["max"].append(np.nan if none else x.max())
            rows["median"].append(np.nan if none else np.median(x))
            rows["std"].append(x.std(ddof=1) if len(x) > 1 else np.nan)
            rows["delta"].append(np.nan if none else y - x.min())
            spread = s.var(ddof=1) if len(s) > 1 else 0
            cov = np.nan if none else (s[ok] * x).mean() - s.mean() * x.mean()
            rows["slope"].append(cov / spread if spread > 0 else np.nan)
        out |= {f"value_{op}_{w}": values for op, values in rows.items()}
    return pd.DataFrame(out)


def same(got, want, columns):
    for c in columns:
        a, b = got[c].astype(float).to_numpy(), want[c].astype(float).to_numpy()
        assert (np.isnan(a) == np.isnan(b)).all(), c
        assert np.allclose(a, b, rtol=1e-7, atol=1e-9, equal_nan=True), c


@pytest.fixture(scope="module")
def expected(sensors):
    return brute(sensors.toPandas().sort_values("row_id").reset_index(drop=True))


@pytest.mark.parametrize("layout", [
    None, lay.WHOLE, lay.Layout(durations.micros("6h")), lay.Layout(durations.micros("1d")),
], ids=["measured", "whole", "halo-6h", "halo-1d"])
def test_windows_match_the_definition(sensors, expected, layout):
    got = built(sensors, layout=layout)
    assert len(got) == sensors.count()
    same(got, expected, expected.columns)


@pytest.mark.parametrize("limit", [1, 10**9], ids=["all-dense", "none-dense"])
def test_dense_windows_match_the_definition(sensors, expected, monkeypatch, limit):
    """Merged cell moments for every window that can be merged."""
    monkeypatch.setattr(dense_windows.choose, "__defaults__", (1,))
    monkeypatch.setattr(dense_windows.attach, "__defaults__", (1, 7))
    monkeypatch.setattr(dense_windows.dense_entities, "__defaults__", (limit,))
    got = built(sensors, layout=lay.Layout(lay.DAY, 60))
    same(got, expected, expected.columns)


def test_each_operation_alone_on_merged_moments(sensors, expected, monkeypatch):
    monkeypatch.setattr(dense_windows.choose, "__defaults__", (1,))
    monkeypatch.setattr(dense_windows.attach, "__defaults__", (1, 7))
    monkeypatch.setattr(dense_windows.dense_entities, "__defaults__", (1,))
    for op in dense_windows.MERGEABLE:
        spec = FeatureSpec.read("s", {"value": {"transforms": [{op: {"windows": ["6h"]}}]}})
        same(built(sensors, spec, lay.Layout(lay.DAY, 60)), expected, [f"value_{op}_6h"])


def test_dense_and_sparse_entities_are_put_together(skewed, monkeypatch):
    """Only the heavy entity passes the limit; the others keep sliding frames."""
    want = built(skewed, layout=lay.WHOLE)
    monkeypatch.setattr(dense_windows.choose, "__defaults__", (100,))
    monkeypatch.setattr(dense_windows.attach, "__defaults__", (100, 50))
    monkeypatch.setattr(dense_windows.dense_entities, "__defaults__", (100,))
    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    plan = lay.measure(skewed, ["machine_id"], us, task_rows=100)
    listed = dense_windows.dense_entities(skewed.withColumn("us", us), "machine_id", "us", [("value", "mean", "1d")])
    assert [r[0] for r in listed.collect()] == ["m0"]
    same(built(skewed, layout=plan), want, [c for c in want.columns if c.startswith("value_")])


def test_heavy_entity_is_cut_and_stays_exact(skewed):
    plan = lay.measure(skewed, ["machine_id"], F.unix_micros(F.col("timestamp").cast("timestamp")), task_rows=100)
    assert not plan.whole and plan.width < lay.DAY
    same(built(skewed, layout=plan), built(skewed, layout=lay.WHOLE), [f"value_{op}_6h" for op in OPS])


def test_a_heavy_entity_is_spread_over_partitions(skewed):
    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    plan = lay.measure(skewed, ["machine_id"], us, task_rows=100)
    buckets = skewed.groupBy("machine_id", plan.bucket(us).alias("b")).count()
    assert buckets.agg(F.max("count")).first()[0] < 200


def test_first_mean_is_the_first_value(sensors):
    single = sensors.dropDuplicates(["machine_id", "timestamp"])  # rows of equal time share their window
    got = built(single.where(F.col("value").isNotNull()))
    first = got.sort_values("timestamp").groupby("machine_id").head(1)
    assert np.allclose(first["value_mean_1h"], first["value_current"])
    assert first["value_std_1h"].isna().all() and first["value_slope_1h"].isna().all()


def test_no_leakage(sensors):
    cut = datetime(2024, 1, 2)
    early = built(sensors.where(F.col("timestamp") <= F.lit(cut).cast("timestamp_ntz")))
    whole = built(sensors)
    kept = whole[whole["row_id"].isin(early["row_id"])].reset_index(drop=True)
    same(early, kept, [c for c in early.columns if c.startswith("value_")])


def test_gap_longer_than_the_window(spark):
    start = datetime(2024, 1, 1)
    rows = [("a", start, 1.0), ("a", start + timedelta(hours=1), 5.0), ("a", start + timedelta(days=3), 9.0)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)],
                               "machine_id string, timestamp timestamp_ntz, value double, row_id long")
    got = built(df)
    assert got["value_mean_1h"].tolist() == [1.0, 5.0, 9.0]  # left end is open
    assert got["elapsed_time"].tolist() == [0.0, 3600.0, 259200.0]
    assert got["hour_of_day"].tolist() == [0.0, 1.0, 0.0] and got["day_of_week"].tolist() == [1.0, 1.0, 4.0]


def test_rejects_unknown_and_unfitted(sensors):
    with pytest.raises(ValueError, match="unsupported transform"):
        features.build_features(sensors, SPEC, FeatureSpec.read("s", {"value": {"transforms": ["lag"]}}))
    with pytest.raises(ValueError, match="no categories learned"):
        features.build_features(sensors, SPEC, FeatureSpec.read("s", {"kind": {"transforms": ["categorical"]}}))
    with pytest.raises(ValueError, match="time key"):
        features.build_features(sensors, DatasetSpec("s", "S", "machine_id"), FeatureSpec.read(
            "s", {"value": {"transforms": [{"mean": {"windows": ["1h"]}}]}}))


def test_new_transform_is_one_entry(sensors, monkeypatch):
    monkeypatch.setitem(features.TRANSFORMS, "square", features.TransformRule(
        lambda _ctx, c, _t: [(f"{c}_square", F.col(c) * F.col(c))]))
    got = built(sensors, FeatureSpec.read("s", {"value": {"transforms": ["current", "square"]}}))
    assert np.allclose(got["value_square"], got["value_current"] ** 2, equal_nan=True)


def test_onehot_learns_on_train_and_zeroes_unknown(spark):
    train = spark.createDataFrame([("x",), ("y",), ("x",), (None,), ("z",)], "kind string")
    spec = FeatureSpec.read("s", {"kind": {"transforms": [{"categorical": {"min_frequency": 1}}]}})
    fitted = features.fit_features(train, spec)
    assert fitted.categories == {"kind": ["x", "y", "z"]}
    again = features.FittedFeatures.from_dict(fitted.to_dict())
    new = spark.createDataFrame([("x",), ("new",), (None,)], "kind string")
    rows = new.select(*[v.alias(n) for n, v in encoding.onehot("kind", again.categories["kind"])]).collect()
    assert [tuple(r) for r in rows] == [(1, 0, 0), (0, 0, 0), (0, 0, 0)]
    assert encoding.fit_categories(train, {"kind": 2}) == {"kind": ["x"]}
    with pytest.raises(ValueError, match="max_categories"):
        encoding.fit_categories(train, {"kind": 1}, 2)


def test_medians_and_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (4.0, 5.0)], "a double, b double").withColumn(
        "c", F.lit(None).cast("double"))
    with pytest.warns(UserWarning, match="imputed with 0"):
        medians = encoding.fit_medians(df, ["a", "b", "c"])
    assert medians == {"a": 2.5, "b": 5.0, "c": 0.0}
    filled = encoding.impute(df, medians)
    assert filled.where("a is null or c is null").count() == 0
    scaling = encoding.fit_scaling(filled, ["a", "b"])
    assert scaling["b"] == (5.0, 1.0)
    z = filled.select(encoding.scaled("a", scaling["a"]).alias("z")).toPandas()["z"]
    assert z.mean() == pytest.approx(0) and z.std(ddof=0) == pytest.approx(1)


def test_one_shuffle_for_all_windows(sensors):
    plan = features.build_features(sensors, SPEC, ALL, layout=lay.Layout(lay.DAY))[0]
    tree = plan._jdf.queryExecution().executedPlan().toString()
    assert tree.count("Exchange hashpartitioning(machine_id") <= 2  # windows, and the first times joined in
