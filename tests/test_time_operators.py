"""Labels, series and joins against brute force, with entities whole and cut into small buckets."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwise.functions import layout as lay
from tabwise.operators import joins, series, targets
from tabwise.plans import durations
from tabwise.plans.specs import DatasetSpec, TargetSpec

SPEC = DatasetSpec("s", "S", "machine_id", "timestamp")
LAYOUTS = [None, lay.WHOLE, lay.Layout(durations.micros("2h")), lay.Layout(durations.micros("1d"))]
IDS = ["measured", "whole", "2h", "1d"]
HOUR = 3_600_000_000


def frame_of(df):
    frame = df.toPandas().sort_values("row_id").reset_index(drop=True)
    frame["us"] = frame["timestamp"].astype("datetime64[us]").astype("int64")
    return frame


def by_row(df):
    return df.toPandas().sort_values("row_id").reset_index(drop=True)


@pytest.mark.parametrize("layout", LAYOUTS, ids=IDS)
def test_future_event(skewed, layout):
    target = TargetSpec("y", "future_event", "failure", "6h", 1)
    got = by_row(targets.select_target(skewed, target, SPEC, ["row_id"]) if layout is None
                 else targets.build_target(skewed, target, SPEC, layout))
    frame = frame_of(skewed)
    hits = frame[frame["failure"] == 1]
    want = [
        int(((hits["machine_id"] == e) & (hits["us"] > t) & (hits["us"] <= t + 6 * HOUR)).any())
        for e, t in zip(frame["machine_id"], frame["us"])
    ]
    assert got["y"].tolist() == want and 0 < sum(want) < len(want)


def test_entity_isolation_and_current_row(spark):
    t = datetime(2024, 1, 1)
    rows = [("A", t, 1), ("A", t + timedelta(hours=2), 0), ("B", t, 0), ("B", t + timedelta(hours=1), 1)]
    df = spark.createDataFrame(rows, "machine_id string, timestamp timestamp_ntz, failure int")
    target = TargetSpec("y", "future_event", "failure", "24h", 1)
    got = {(r.machine_id, r.timestamp): r.y for r in targets.build_target(df, target, SPEC).collect()}
    assert [got[r[:2]] for r in rows] == [0, 0, 1, 0]


def test_other_targets_and_errors(spark, sensors):
    rows = targets.build_target(sensors, TargetSpec("y", "classification", "kind", positive_class="a"), SPEC)
    assert rows.where("y = 1").count() == sensors.where("kind = 'a'").count()
    null = spark.createDataFrame([(None,), ("a",)], "kind string")
    assert {r.y for r in targets.build_target(null, TargetSpec("y", "binary", "kind", positive_class="a"), SPEC).collect()} == {None, 1}
    assert dict(targets.build_target(sensors, TargetSpec("y", "regression", "failure"), SPEC).dtypes)["y"] == "double"
    with pytest.raises(ValueError, match="horizon"):
        targets.build_target(sensors, TargetSpec("y", "future_event", "failure"), SPEC)
    with pytest.raises(ValueError, match="time key"):
        targets.build_target(sensors, TargetSpec("y", "future_event", "failure", "1h"), DatasetSpec("s", "S", "machine_id"))
    with pytest.raises(ValueError, match="missing"):
        targets.build_target(sensors, TargetSpec("y", "binary", "nope"), SPEC)


@pytest.mark.parametrize("layout", LAYOUTS, ids=IDS)
def test_time_to_next_event(skewed, layout):
    got = by_row(series.time_to_next_event(skewed, "machine_id", "timestamp", F.col("failure") == 1, layout=layout))
    frame = frame_of(skewed)
    hits = frame[frame["failure"] == 1]
    want = []
    for e, t in zip(frame["machine_id"], frame["us"]):
        ahead = hits.loc[(hits["machine_id"] == e) & (hits["us"] >= t), "us"]
        want.append((ahead.min() - t) / HOUR if len(ahead) else 9999.0)
    assert np.allclose(got["hours_to_event"], want)


@pytest.mark.parametrize("layout", LAYOUTS, ids=IDS)
def test_row_frames(skewed, layout):
    kw = {"ties": ["row_id"], "layout": layout, "chunk_rows": 17}
    args = ("machine_id", "timestamp")
    df = skewed.withColumn("value", F.coalesce("value", F.lit(40.0)))
    frame = frame_of(df).sort_values(["machine_id", "us", "row_id"])
    group = frame.groupby("machine_id")
    back = lambda s: s.reindex(frame.index).sort_index().to_numpy()

    lagged = by_row(series.lags(df, *args, "value", [1, 3], 0.0, **kw))
    for k in (1, 3):
        assert np.allclose(lagged[f"value_lag_{k}"], back(group["value"].shift(k).fillna(0.0)))

    ahead = pd.concat([group["value"].shift(-k) for k in (1, 2, 3)], axis=1)
    strict = by_row(series.forward_sum(df, *args, "value", 3, **kw))["value_next_3_sum"]
    assert np.allclose(strict.astype(float), back(ahead.sum(axis=1, min_count=3).where(ahead.notna().all(axis=1))), equal_nan=True)
    partial = by_row(series.forward_sum(df, *args, "value", 3, strict=False, out="s", **kw))["s"]
    assert np.allclose(partial.astype(float), back(ahead.sum(axis=1, min_count=1)), equal_nan=True)

    soon = pd.concat([group["failure"].shift(-k) for k in (1, 2)], axis=1).fillna(0).max(axis=1)
    got = by_row(series.forward_any(df, *args, F.col("failure") == 1, 2, "soon", **kw))["soon"]
    assert (got == back(soon)).all()

    past = pd.concat([group["value"].shift(k) for k in (1, 2, 3)], axis=1).mean(axis=1)
    trend = ((frame["value"] - past) / past.clip(lower=1) * 100).clip(-50, 100)
    got = by_row(series.trend_percent(df, *args, "value", **kw))["value_trend_pct"]
    assert np.allclose(got.astype(float), back(trend), equal_nan=True)

    now = pd.concat([group["value"].shift(-k) for k in (0, 1, 2)], axis=1).min(axis=1) < 30
    bad = pd.concat([group["kind"].shift(-k) == "c" for k in (1, 2)], axis=1).any(axis=1)
    got = by_row(series.forward_risk(df, *args, "value", 30.0, "kind", "c", 2, "risk", **kw))["risk"]
    assert (got == back((now | bad).astype(int))).all()


@pytest.mark.parametrize("layout", LAYOUTS, ids=IDS)
def test_as_of_join(spark, skewed, layout):
    frame = frame_of(skewed)
    times = [datetime(2023, 12, 31), datetime(2024, 1, 1, 0, 7), datetime(2024, 1, 1, 13), datetime(2024, 1, 2, 5), datetime(2025, 1, 1)]
    asked = [(e, t) for e in ("m0", "m1", "m4", "unknown") for t in times]
    asked += [(r.machine_id, r.timestamp.to_pydatetime()) for r in frame.sample(30, random_state=1).itertuples()]
    requests = spark.createDataFrame([(*a, i) for i, a in enumerate(asked)], "machine_id string, as_of timestamp_ntz, id int")
    seen = skewed.select("machine_id", "timestamp", "row_id", "value")
    got = joins.as_of_join(requests, seen, "machine_id", "as_of", "timestamp", ties=["row_id"], layout=layout)
    found = {r.id: r for r in got.collect()}
    assert len(found) == len(asked)
    for i, (e, t) in enumerate(asked):
        before = frame[(frame["machine_id"] == e) & (frame["timestamp"] <= t)].sort_values(["us", "row_id"])
        assert found[i].row_id == (None if before.empty else before.iloc[-1]["row_id"])
    with pytest.raises(ValueError, match="prefix"):
        joins.as_of_join(requests.withColumn("value", F.lit(1)), seen, "machine_id", "as_of", "timestamp")


@pytest.mark.parametrize("layout", LAYOUTS, ids=IDS)
def test_first_within(skewed, layout):
    left = skewed.where("kind = 'a'").select("machine_id", "timestamp", "row_id")
    right = skewed.where("failure = 1").select("machine_id", "timestamp")
    got = joins.first_within(left, right, "machine_id", "timestamp", "timestamp", 3 * HOUR, layout=layout)
    found = {r.row_id: r for r in got.collect()}
    a, b = frame_of(left), frame_of(right.withColumn("row_id", F.lit(0)))
    assert len(found) == len(a)
    for r in a.itertuples():
        ahead = b.loc[(b["machine_id"] == r.machine_id) & (b["us"] > r.us) & (b["us"] <= r.us + 3 * HOUR), "timestamp"]
        assert found[r.row_id].has_event == (len(ahead) > 0)
        assert found[r.row_id].first_time == (ahead.min().to_pydatetime() if len(ahead) else None)


def test_latest_per_entity(skewed):
    frame = frame_of(skewed)
    cut = pd.Timestamp("2024-01-01 20:00:00")
    got = joins.latest_per_entity(skewed, "machine_id", "timestamp", "2024-01-01 20:00:00", ties=["row_id"])
    want = frame[frame["timestamp"] <= cut].sort_values(["us", "row_id"]).groupby("machine_id").tail(1)
    assert {(r.machine_id, r.row_id) for r in got.collect()} == set(zip(want["machine_id"], want["row_id"]))
    assert got.columns == skewed.columns
    recent = joins.latest_per_entity(skewed, "machine_id", "timestamp", "2024-01-01 20:00:00", 10 * 60 * 1_000_000)
    assert recent.count() <= got.count()


def test_labels_never_multiply_rows(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, x string")
    labels = spark.createDataFrame([(1, 0), (1, 1)], "k int, y int")
    rows = joins.attach_label(left, labels, ["k"]).collect()
    assert sorted((r.x, r.y) for r in rows if r.y is not None) == [("a", 1), ("b", 1)] and len(rows) == 3


def test_scalars(spark):
    df = spark.createDataFrame([(5.0, 0.0, "a"), (None, 2.0, "b")], "x double, d double, k string")
    rows = df.select(
        series.coverage("x", "d").alias("c"), series.composite_key("k", F.lit("z")).alias("key"),
        series.rule_label({"big": F.col("x") > 3, "some": F.col("d") > 1}, "none").alias("rule")).collect()
    assert [tuple(r) for r in rows] == [(5.0, "a__z", "big"), (None, "b__z", "some")]
