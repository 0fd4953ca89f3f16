"""Windows of many rows: bounded tasks, linear work, exact results."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwise.functions import layout as lay
from tabwise.functions import moments, rank_index
from tabwise.functions.grouping import locate
from tabwise.operators import dense_windows
from tabwise.plans import durations

HOUR = durations.micros("1h")


def attached(df, triples, task_rows, per_day):
    work = df.withColumn("us", F.unix_micros(F.col("time").cast("timestamp")))
    out, names = dense_windows.attach(work, "machine", "us", triples, lay.Layout(None, per_day), 0, task_rows)
    return out.select("id", *[F.col(v).alias(k) for k, v in names.items()]).toPandas().set_index("id").sort_index()


def brute(rows, triples):
    frame = {r[0]: [] for r in rows}
    for i, machine, time, _ in rows:
        for _, op, w in triples:
            span = timedelta(microseconds=durations.micros(w))
            v = [x for _, m, t, x in rows if m == machine and x is not None and time - span < t <= time]
            frame[i].append(np.nan if not v else {"median": np.median, "mean": np.mean, "min": np.min, "max": np.max,
                                                  "std": lambda a: np.std(a, ddof=1) if len(a) > 1 else np.nan}[op](v))
    return np.array([frame[k] for k in sorted(frame)], float)


@pytest.fixture
def largest(monkeypatch):
    """Rows of the largest group that any task of the operator gets."""
    seen, real = [], dense_windows.by_group

    def spy(df, keys, *rest, **more):
        if dense_windows.CELL in keys:
            seen.append(df.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return real(df, keys, *rest, **more)

    monkeypatch.setattr(dense_windows, "by_group", spy)
    return seen


def crowd(spark, n=750, same=False, values=None, seed=1):
    """A third of the rows in one window of machine a (or at one time of it), the others spread over 40 days."""
    rng, start, rows = np.random.default_rng(seed), datetime(2024, 3, 1), []
    for i in range(n):
        value = None if i % 17 == 0 else float(rng.normal(10, 5)) if values is None else float(rng.integers(0, values))
        if i % 3 == 0:
            rows.append((i, "a", start + timedelta(days=20, seconds=0 if same else int(rng.integers(0, 86_000))), value))
        else:
            rows.append((i, "ab"[i % 2], start + timedelta(seconds=int(rng.integers(0, 40 * 86_400))), value))
    return rows, spark.createDataFrame(rows, "id int, machine string, time timestamp_ntz, value double").repartition(4)


@pytest.mark.parametrize("values", [None, 3])
def test_no_task_holds_a_median_window(spark, largest, values):
    triples = [("value", "median", "5d"), ("value", "median", "1d")]
    rows, df = crowd(spark, values=values)
    got = attached(df, triples, 25, 300)
    assert np.allclose(got.to_numpy(float), brute(rows, triples), equal_nan=True)
    assert max(largest) < 160  # the window of five days holds over 280


def test_crowded_time_is_one_point(spark, largest):
    triples = [("value", op, "2d") for op in ("mean", "std", "min", "max")]
    rows, df = crowd(spark, same=True)
    got = attached(df, triples, 20, 300)
    assert np.allclose(got.to_numpy(float), brute(rows, triples), equal_nan=True)
    assert max(largest) < 60  # 250 rows share one time
    tied, equal = crowd(spark, same=True, values=2)
    medians = [("value", "median", "2d")]
    assert np.allclose(attached(equal, medians, 20, 300).to_numpy(float), brute(tied, medians), equal_nan=True)


def test_short_and_long_windows_stay_linear(spark, monkeypatch):
    rows, counts = 4000, {}
    start = datetime(2024, 1, 1)
    df = spark.range(rows).select(F.col("id").cast("int"), F.lit("a").alias("machine"),
                                  (F.lit(start) + F.expr("make_dt_interval(0, 0, 0, id * 7200)")).cast("timestamp_ntz").alias("time"),
                                  (F.col("id") % 31).cast("double").alias("value"))
    real = dense_windows.by_group

    def spy(frame, keys, *more):
        counts[tuple(keys)] = counts.get(tuple(keys), 0) + frame.count()
        return real(frame, keys, *more)

    monkeypatch.setattr(dense_windows, "by_group", spy)
    triples = [("value", "mean", "1h"), ("value", "max", "52w")]
    got = attached(df, triples, 100, 12)
    assert counts[("__e", dense_windows.SET, dense_windows.CELL)] == 4 * rows  # points and probes, once per window
    assert counts[("__e",)] < rows / 50  # cells of the long window, not of the short one
    values = np.arange(rows) % 31
    assert (got["value_mean_1h"] == values).all()
    assert (got["value_max_52w"] == np.maximum.accumulate(values)).all()


def test_widths_divide_their_windows():
    plan = lay.Layout(None, 1_000_000)
    for window in ("1h", "52w", "3d", "7h"):
        width = dense_windows.cell_width(window, plan, 250_000)
        assert durations.micros(window) % width == 0 and width <= lay.DAY // 4 + 1
    assert dense_windows.cell_width("1h", plan, 250_000) == HOUR


@pytest.mark.parametrize("seed", range(5))
def test_ranks_of_many_windows(seed):
    rng = np.random.default_rng(seed)
    codes, weights = rng.integers(0, 37, 200), rng.integers(0, 4, 200)
    start = rng.integers(0, 100, 50)
    ranges = [(start, start + rng.integers(1, 40, 50)), (np.full(50, 150), np.full(50, 190))]
    for k in range(50):
        held = np.sort(np.concatenate([np.repeat(codes[a[k]:b[k]], weights[a[k]:b[k]]) for a, b in ranges]))
        for rank in {0, len(held) // 2, len(held) - 1}:
            got = rank_index.select(codes, weights, [(a[[k]], b[[k]]) for a, b in ranges], np.array([rank]))
            assert got[0] == held[rank]


@pytest.mark.parametrize("samples,ties", [(3, 5), (7, 1000), (1000, 50)])
def test_bracket_holds_every_median(samples, ties):
    rng = np.random.default_rng(samples)
    for _ in range(30):
        cells = [np.sort(rng.integers(0, ties, rng.integers(1, 60))) for _ in range(rng.integers(1, 5))]
        low, high = rank_index.bracket([rank_index.index(*map(np.asarray, np.unique(c, return_counts=True)), samples) for c in cells], 9)
        for others in (rng.integers(0, ties, rng.integers(0, 10)) for _ in range(20)):
            every = np.sort(np.concatenate([*cells, others]))
            for median in (every[(len(every) - 1) // 2], every[len(every) // 2]):
                assert low < median <= high or median in others


def test_order_of_doubles():
    values = np.array([-np.inf, -3.5, -1e-300, -0.0, 0.0, 2.0, 1e300, np.inf, np.nan])
    keys = rank_index.ordered(values)
    assert (np.diff(keys) >= 0).all() and keys[3] == keys[4]
    assert np.array_equal(rank_index.doubles(keys), values, equal_nan=True)


def test_windows_of_moments_match_direct_merges():
    rng = np.random.default_rng(3)
    y = rng.normal(5, 2, 90)
    one = {"n": np.ones(90), "ym": y, "y2": np.zeros(90)}
    start = rng.integers(0, 90, 40)
    end = np.minimum(90, start + rng.integers(0, 60, 40))
    got = moments.windows(one, start, end)
    for a, b, n, mean, spread in zip(start, end, got["n"], got["ym"], got["y2"]):
        assert n == b - a
        if n:
            assert mean == pytest.approx(y[a:b].mean()) and spread == pytest.approx(y[a:b].var() * n, abs=1e-9)
    first = np.arange(90) // 10 * 10
    heads, tails = moments.prefixes(one, first), moments.suffixes(one, first + 9)
    for i in range(90):
        assert heads["ym"][i] == pytest.approx(y[first[i]:i + 1].mean())
        assert tails["ym"][i] == pytest.approx(y[i:first[i] + 10].mean())


def test_locate_is_searchsorted_per_group():
    rng = np.random.default_rng(6)
    group = np.sort(rng.integers(0, 5, 80))
    at = rng.integers(0, 20, 80)
    at = at[np.lexsort((at, group))]
    asked_group, asked = rng.integers(0, 5, 60), rng.integers(-2, 22, 60)
    for side in ("left", "right"):
        got = locate(group, at, asked_group, asked, side)
        for g, a, x in zip(asked_group, asked, got):
            base = np.searchsorted(group, g)
            assert x == base + np.searchsorted(at[group == g], a, side)
