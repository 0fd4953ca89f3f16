from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwise.functions import quantiles
from tabwise.operators import analysis, slices

ROWS = [("a", "x", 1.0), ("a", "x", 3.0), ("a", "y", None), ("b", "y", None), (None, "x", 7.0), (None, "y", 10.0)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "g string, h string, v double")


def test_null_rules(table):
    got = {r.g: r for r in analysis.slice_by(table, ["g"], "v", "sum").collect()}
    assert got["b"].v_sum == 0 and got["b"].row_count == 1 and got[None].v_sum == 17.0
    counts = {r.g: r.v_count for r in analysis.slice_by(table, ["g"], "v", "count").collect()}
    assert counts == {"a": 2, "b": 0, None: 2}
    spread = {r.g: r.v_std for r in analysis.slice_by(table.where("h = 'x'"), ["g"], "v", "std").collect()}
    assert spread[None] is None and spread["a"] == pytest.approx(2 ** 0.5)


def test_compare_uses_the_same_aggregation_for_the_whole(table):
    rows = {r.h: r for r in analysis.compare(table, "h", "v", "max").collect()}
    assert rows["x"].overall == 10.0 and rows["x"].relative_diff == pytest.approx(-0.3)
    empty = analysis.compare(table.where("g = 'b'"), "h", "v").collect()
    assert empty[0].relative_diff is None


def test_unknown_aggregation(table):
    with pytest.raises(ValueError):
        analysis.slice_by(table, ["g"], "v", "mode")
    with pytest.raises(ValueError):
        analysis.aggregate_by(table, ["g"], {"v": "mode"})


def test_order_and_limit(table):
    rows = analysis.slice_by(table, ["g"], "v", "mean", order_by="v_mean", limit=2).collect()
    assert [r.g for r in rows] == ["b", None]  # nulls first


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(3)
    n = 3000
    skewed = np.where(rng.random(n) < 0.4, "hot", rng.choice(["p", "q", "r"], n))
    frame = pd.DataFrame({
        "a": skewed, "b": rng.choice(["1", "2"], n), "c": rng.choice(["u", "v", "w"], n),
        "m": np.round(1000 + rng.gamma(2.0, 3.0, n) + (skewed == "q") * 5, 2)})
    frame.loc[frame.index % 97 == 0, "m"] = np.nan
    frame.loc[frame.index % 31 == 0, "b"] = None
    df = spark.createDataFrame(frame).withColumn("m", F.nanvl("m", F.lit(None)))
    return df.cache(), frame


def brute_slices(frame, dims, how, least):
    overall = getattr(frame["m"], how)()
    out = {}
    for size in (1, 2, 3):
        for combo in combinations(dims, size):
            for values, part in frame.groupby(list(combo), dropna=False):
                if len(part) >= least and not np.isnan(getattr(part["m"], how)()):
                    key = tuple((d, None if pd.isna(v) else v) for d, v in zip(combo, values))
                    m = part["m"]
                    out[key] = (len(part), getattr(m, how)(), m.median(), m.std(), abs(getattr(m, how)() - overall))
    return out


@pytest.mark.parametrize("how", ["mean", "std", "median", "max", "count"])
def test_interesting_slices_match_brute_force(wide, how):
    df, frame = wide
    want = brute_slices(frame, ["a", "b", "c"], how, 40)
    rows = slices.interesting_slices(df, "m", ["a", "b", "c"], 40, aggregation=how, top_k=15).collect()
    best = sorted((v[4] for v in want.values()), reverse=True)[:15]
    assert [r.abs_difference for r in rows] == pytest.approx(best, rel=1e-9)
    for r in rows:
        n, value, median, std, _ = want[tuple((d, r["values"][d]) for d in r.dimensions)]
        assert (r.row_count, r.n_dimensions) == (n, len(r.dimensions))
        assert (r.metric_value, r.metric_median, r.metric_std) == pytest.approx((value, median, std), rel=1e-9)


def test_slices_batch_and_empty(wide, monkeypatch):
    df, _ = wide
    whole = slices.interesting_slices(df, "m", ["a", "b", "c"], 40).collect()
    monkeypatch.setattr(slices, "SLICES_PER_PASS", 3)
    assert slices.interesting_slices(df, "m", ["a", "b", "c"], 40).collect() == whole
    assert slices.interesting_slices(df.where("a = 'none'"), "m", ["a"], 1).collect() == []
    assert slices.interesting_slices(df, "m", ["a", "b"], 10**6).collect() == []


@pytest.mark.parametrize("keys", [[], ["a"], ["a", "b"]])
def test_bracketed_quantiles_are_exact(wide, keys):
    """A tiny buffer forces the sketch-and-count path that heavy groups take."""
    df, frame = wide
    wanted = {"p25": 0.25, "med": 0.5, "p95": 0.95, "low": 0.0, "top": 1.0}
    got = quantiles.group_quantiles(df, keys, "m", wanted, ["p25"], buffer_rows=10, accuracy=40)
    slow = {r[0:len(keys)]: r for r in got.collect()}
    groups = [((), frame)] if not keys else list(frame.groupby(keys, dropna=False))
    assert len(slow) == len(groups)
    for key, part in groups:
        key = key if isinstance(key, tuple) else (key,)
        row = slow[tuple(None if pd.isna(k) else k for k in key)]
        x = np.sort(part["m"].dropna().to_numpy())
        assert row.p25 == x[int(np.floor((len(x) - 1) * 0.25 + 0.5))]
        assert (row.med, row.p95, row.low, row.top) == pytest.approx(
            (np.median(x), np.percentile(x, 95), x[0], x[-1]), rel=1e-12)


def test_quantiles_of_a_null_group(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("b", 2.0)], "k string, v double")
    for buffer in (0, 100):
        got = {r.k: r.m for r in quantiles.group_quantiles(df, ["k"], "v", {"m": 0.5}, buffer_rows=buffer).collect()}
        assert got == {"a": None, "b": 1.5}


@pytest.mark.parametrize("aggregation", ["mean", "median", "std"])
def test_iceberg_keeps_what_is_large_enough(wide, monkeypatch, caplog, aggregation):
    """Level by level the same slices come out, and combinations of small slices are never formed."""
    df, _ = wide
    ask = lambda: [tuple(map(str, r)) for r in slices.interesting_slices(
        df, "m", ["a", "b", "c"], min_sample_size=260, aggregation=aggregation, top_k=50).select(
            "dimensions", "values", "row_count", F.round("metric_value", 6), F.round("metric_median", 6)).collect()]
    want = ask()
    monkeypatch.setattr(slices, "TOGETHER_ROWS", 0)
    caplog.set_level("INFO", logger=slices.__name__)
    assert ask() == want and want
    cells = df.groupBy("a", "b", "c").agg(F.count(F.lit(1)).cast("long").alias("__rows"))
    found = slices.iceberg(cells, ["a", "b", "c"], slices.dimension_sets(["a", "b", "c"], 3), 260).collect()
    direct = {}
    for combo in slices.dimension_sets(["a", "b", "c"], 3):
        for r in df.groupBy(*combo).count().where("count >= 260").collect():
            direct[tuple(r[d] if d in combo else None for d in "abc") + (slices._set_id(["a", "b", "c"], combo),)] = r["count"]
    assert {(r.a, r.b, r.c, r.set_id): r.row_count for r in found} == direct
    assert "slices of 3 dimensions" in caplog.text
