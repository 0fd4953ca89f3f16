from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwise.operators import features, targets
from tabwise.plans.specs import DatasetSpec, FeatureSpec, TargetSpec
from tabwise.streaming import labels, rolling, state, validation

SPEC = DatasetSpec.read({
    "dataset_id": "s", "entity_key": "machine_id", "time_key": "timestamp",
    "columns": {"machine_id": {"type": "categorical", "role": "identifier"}, "timestamp": {"type": "timestamp"},
                "value": {"type": "numeric"}, "failure": {"type": "boolean", "role": "event"}}})
WINDOWS = FeatureSpec.read("s", {"value": {"transforms": [
    {op: {"windows": ["2h", "6h"]}} for op in ("mean", "min", "max", "std", "median", "delta")]}})
SLOPES = FeatureSpec.read("s", {"value": {"transforms": [
    "elapsed_time", *[{op: {"windows": ["2h", "6h"]}} for op in ("slope", "mean", "std")]]}})


@pytest.fixture(scope="module")
def arrivals(spark, sensors, tmp_path_factory):
    """Three files in time order; the reader takes one file per micro-batch."""
    root = tmp_path_factory.mktemp("arrivals")
    edges = [datetime(2023, 1, 1), datetime(2024, 1, 1, 20), datetime(2024, 1, 2, 12), datetime(2030, 1, 1)]
    for i in range(3):
        part = sensors.where((F.col("timestamp") >= F.lit(edges[i]).cast("timestamp_ntz"))
                             & (F.col("timestamp") < F.lit(edges[i + 1]).cast("timestamp_ntz")))
        part.coalesce(1).write.parquet(str(root / f"part-{i}"))
    return root


def stream_of(spark, arrivals, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(arrivals / "part-*"))


def finish(spark, df, place):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKSDB)
    query = (df.writeStream.format("parquet").option("path", str(place / "out")).outputMode("append")
             .option("checkpointLocation", str(place / "ck")).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(str(place / "out"))


@pytest.mark.parametrize("spec", [WINDOWS, SLOPES], ids=["buckets", "entities"])
@pytest.mark.parametrize("block", [4, 512])
def test_streamed_windows_equal_batch_windows_of_closed_rows(spark, sensors, arrivals, tmp_path, spec, block):
    out = rolling.rolling_features(stream_of(spark, arrivals, sensors.schema), SPEC, spec, ["row_id"],
                                   delay="1 hour", bucket="8h", block=block)
    got = {r.row_id: r for r in finish(spark, out, tmp_path).collect()}
    batch, _ = features.build_features(sensors, SPEC, spec, keep=["row_id"])
    want = {r.row_id: r for r in batch.collect()}
    latest = max(r.timestamp for r in want.values())
    closed = {i for i, r in want.items() if r.timestamp <= latest - timedelta(hours=1, milliseconds=1)}
    assert set(got) == closed
    for i in closed:
        for name in (c for c in batch.columns if c.startswith("value_") or c == "elapsed_time"):
            a, b = got[i][name], want[i][name]
            assert (a is None or a != a) == (b is None) and (b is None or a == pytest.approx(b, abs=1e-6)), name


@pytest.mark.parametrize("block", [3, 512])
def test_delayed_labels_equal_batch_labels_of_closed_rows(spark, sensors, arrivals, tmp_path, block):
    target = TargetSpec("y", "future_event", "failure", "4h", 1)
    out = labels.delayed_labels(stream_of(spark, arrivals, sensors.schema), SPEC, target, ["row_id"], bucket="8h", block=block)
    got = {r.row_id: r.y for r in finish(spark, out, tmp_path).collect()}
    rows = targets.build_target(sensors, target, SPEC).collect()
    latest = max(r.timestamp for r in rows)
    want = {r.row_id: r.y for r in rows if r.timestamp <= latest - timedelta(hours=5, milliseconds=1)}
    assert got == want and 0 < sum(got.values())


def test_streamed_scores_equal_batch_scores(spark, sensors, arrivals, tmp_path):
    from tabwise.operators import models
    from tabwise.plans.specs import DatasetConfig

    config = DatasetConfig.read({
        "dataset": {"dataset_id": "s", "entity_key": "machine_id", "time_key": "timestamp"},
        "features": {"value": {"transforms": ["current", {"mean": {"windows": ["2h"]}}, {"delta": {"windows": ["6h"]}},
                                               {"slope": {"windows": ["6h"]}}, "elapsed_time"]},
                     "kind": {"transforms": ["categorical", "hour_of_day"]}},
        "target": {"name": "y", "type": "binary", "source_column": "kind", "positive_class": "a"}})
    model = models.train_model(sensors, config, "m", "logistic_regression", ties=["row_id"])
    out = rolling.score_stream(stream_of(spark, arrivals, sensors.schema), model, ["row_id"], bucket="8h")
    got = {r.row_id: r for r in finish(spark, out, tmp_path).collect()}
    batch, _ = features.build_features(sensors, config.dataset, config.features, model.fitted, ["row_id"])
    rows = model.transform(batch).collect()
    latest = max(r.timestamp for r in rows)
    want = {r.row_id: r for r in rows if r.timestamp <= latest - timedelta(hours=1, milliseconds=1)}
    assert set(got) == set(want)
    assert all(got[i].prediction == pytest.approx(want[i].prediction, abs=1e-9) for i in want)


def test_unsupported_streams(spark, sensors, arrivals):
    stream = stream_of(spark, arrivals, sensors.schema)
    with pytest.raises(ValueError, match="streamed windows"):
        rolling.rolling_features(stream, SPEC, FeatureSpec.read("s", {"value": {"transforms": ["current"]}}))
    with pytest.raises(ValueError, match="horizon"):
        labels.delayed_labels(stream, SPEC, TargetSpec("y", "binary", "failure"))


def test_stream_validation_sets_late_rows_aside(spark, tmp_path):
    schema = "machine_id string, timestamp timestamp_ntz, value double, failure int"
    handle = validation.validator(SPEC, str(tmp_path / "out"), "1h")
    t = datetime(2024, 1, 1, 12)
    first = spark.createDataFrame([("a", t, 1.0, 0), ("a", t, 2.0, 0), (None, t, 1.0, 0)], schema)
    second = spark.createDataFrame([("a", t - timedelta(hours=2), 1.0, 0), ("b", t + timedelta(hours=1), 1.0, 1)], schema)
    handle(first, 0)
    handle(second, 1)
    handle(second, 1)  # a repeated batch changes nothing
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
    assert read("late").select("batch_id", "machine_id").collect() == [(1, "a")]
    assert read("rows").count() == 4
    found = {(r.batch_id, r.check): r.n_violations for r in read("report").collect()}
    assert found == {(0, "entity_null"): 1, (0, "duplicate_keys"): 1}


class Counted:
    """Blocks in memory that count how often entries are written and read."""

    def __init__(self):
        self.held, self.written, self.read = {}, 0, 0

    def write(self, number, body):
        assert number not in self.held
        self.held[number] = body
        self.written += len(body[0])

    def take(self, number):
        body = self.held.pop(number)
        self.read += len(body[0])
        return body


def test_work_per_arrival_does_not_depend_on_the_window():
    """Two-stack windows equal direct ones, and every point is written and read a bounded number of times."""
    import numpy as np

    from tabwise.functions import moments
    from tabwise.streaming.queues import Window

    rng = np.random.default_rng(1)
    times = np.cumsum(rng.integers(1, 20, 6000)).astype(np.int64)
    times[3000:] += 400  # a gap that outlasts the short windows
    values = rng.normal(3, 2, 6000)
    values[rng.random(6000) < 0.1] = np.nan
    one = moments.of_points(values, times.astype(float), np.arange(6000))
    for span in (5, 300, 3000, 30_000):
        blocks, window, got, at = Counted(), Window(span, 1, 0, block=32), [], 0
        while at < len(times):
            step = int(rng.integers(1, 200))
            got += window.advance(times[at:at + step], [moments.take(one, slice(at, at + step))], blocks)
            at += step
        found = moments.joined(got)
        for k in rng.integers(0, 6000, 150):
            held = values[:k + 1][times[:k + 1] > times[k] - span]
            held = held[~np.isnan(held)]
            assert found["n"][k] == len(held)
            if len(held):
                assert found["ym"][k] == pytest.approx(held.mean()) and found["low"][k] == held.min()
                assert found["y2"][k] == pytest.approx(held.var() * len(held), abs=1e-6)
        assert blocks.written <= 2 * 6000 and blocks.read <= 2 * 6000 + 64
        window.clear(blocks)
        assert not blocks.held


class Held(dict):
    """Overflow blocks in memory."""

    def write(self, number, body):
        self[number] = body

    def take(self, number):
        return self.pop(number)


@pytest.mark.parametrize("block", [3, 512])
def test_labels_of_many_entities_come_from_one_key(block):
    """A key holds a group of entities; each is labelled by its own events, those told by later buckets included."""
    rng, horizon, end = np.random.default_rng(3), 40, 1000
    n = 500
    rows = pd.DataFrame({"who": [None if k == 7 else f"e{k}" for k in rng.integers(0, 40, n)], "n": range(n),
                         state.US: np.sort(rng.integers(0, end, n)), state.OWN: True})
    rows[labels.HIT] = rng.random(n) < 0.2
    later = {f"e{k}": end + 10 * k for k in range(5)}
    work, blocks, got = labels.LabelWork("y", "who", horizon, block), Held(), {}
    memory = work.fresh() | {"later": dict(later)}
    for closed in range(50, end + 400, 50):
        final = rows[(rows[state.US] <= closed) & (rows[state.US] > closed - 50)].reset_index(drop=True)
        emitted, memory, again = work.step(memory, final, closed, blocks)
        assert (emitted[state.US] <= closed - horizon).all() if len(emitted) else True
        got |= dict(zip(emitted["n"], emitted["y"]))
    assert memory is None and again is None and not blocks

    def known(row):
        mine = rows[(rows["who"].fillna("") == (row["who"] or "")) & rows[labels.HIT]][state.US].tolist()
        return int(any(0 < t - row[state.US] <= horizon for t in [*mine, later.get(row["who"], 10 * end)]))

    assert got == {row["n"]: known(row) for row in rows.to_dict("records")}


@pytest.mark.parametrize("block", [3, 512])
def test_windows_of_many_entities_come_from_one_key(block):
    """Light and heavy entities of a key, over several steps, against each row's own window."""
    rng, span, n = np.random.default_rng(4), 4_000_000, 400
    rows = pd.DataFrame({"who": [None if k == 7 else f"e{k}" for k in rng.integers(0, 20, n)], "n": range(n),
                         "x": np.where(rng.random(n) < 0.2, np.nan, rng.normal(size=n)),
                         state.US: np.sort(rng.integers(0, 20, n)) * 1_000_000, state.OWN: rng.random(n) < 0.9})
    wanted = tuple(("x", op, "4s") for op in ("mean", "std", "min", "max", "delta", "median"))
    work, blocks, got = rolling.GroupWork(rolling.RollingWork(wanted, False, False, block), "who"), Held(), []
    memory = None
    for closed in range(2_000_000, 30_000_001, 2_000_000):
        final = rows[(rows[state.US] <= closed) & (rows[state.US] > closed - 2_000_000 * (1 if closed > 2_000_000 else 9))]
        emitted, memory, again = work.step(memory, final.reset_index(drop=True), closed, blocks)
        got.append(emitted)
    assert memory is None and again is None and not blocks
    got = pd.concat([g for g in got if len(g)]).set_index("n")
    assert sorted(got.index) == sorted(rows.loc[rows[state.OWN], "n"])
    for row in rows[rows[state.OWN]].to_dict("records"):
        mine = rows[rows["who"].fillna("") == (row["who"] or "")]
        x = mine.loc[(mine[state.US] <= row[state.US]) & (mine[state.US] > row[state.US] - span), "x"]
        want = {"mean": x.mean(), "std": x.std(), "min": x.min(), "max": x.max(), "delta": row["x"] - x.min(), "median": x.median()}
        for op, value in want.items():
            assert got.loc[row["n"], f"x_{op}_4s"] == pytest.approx(value, abs=1e-9, nan_ok=True), (row, op)
