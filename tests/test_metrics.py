import numpy as np
import pandas as pd
import pytest

from tabwise.functions import running
from tabwise.operators import metrics


def scored(spark, y, p):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")


@pytest.fixture(scope="module")
def tied():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 900)
    return y, np.round(np.clip(y * 0.15 + rng.random(900) * 0.8, 0, 1), 2)


def curve(y, p):
    """Precision and recall at every distinct threshold, ascending, straight from the definition."""
    points = []
    for t in np.unique(p):
        hit = p >= t
        points.append((t, (y[hit] == 1).mean(), (y[hit] == 1).sum() / (y == 1).sum()))
    return points


def auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_perfect_separation(spark):
    df = scored(spark, [0, 0, 1, 1, 0, 1], [.1, .4, .8, .9, .3, .7])
    row = metrics.evaluate_binary(df, "y", "p", 0.5).first()
    assert (row.tn, row.fp, row.fn, row.tp) == (3, 0, 0, 3)
    assert (row.precision, row.recall, row.f1, row.roc_auc, row.pr_auc) == (1, 1, 1, 1, 1)


@pytest.mark.parametrize("single_task_rows", [10**6, 0], ids=["one-task", "bucketed"])
def test_ranking_with_ties(spark, tied, monkeypatch, single_task_rows):
    monkeypatch.setattr(running.running_totals, "__defaults__", (True, single_task_rows, 50))
    y, p = tied
    table = metrics.score_table(scored(spark, y, p), "y", "p")
    row = metrics.ranking_metrics(table).first()
    points = curve(y, p)
    recall = np.array([r for _, _, r in points] + [0.0])
    average_precision = sum((recall[i] - recall[i + 1]) * pr for i, (_, pr, _) in enumerate(points))
    assert row.roc_auc == pytest.approx(auc(y, p)) and row.pr_auc == pytest.approx(average_precision)

    f1 = [2 * a * b / (a + b + 1e-12) for _, a, b in points]
    best = metrics.best_threshold(table).first()
    assert best.threshold == points[int(np.argmax(f1))][0] and best.f1 == pytest.approx(max(f1))

    for wanted in (200, 20):
        got = metrics.pr_curve(table, wanted).orderBy("position").collect()
        whole = points + [(None, 1.0, 0.0)]
        step = len(whole) // wanted if len(whole) > wanted else 1
        want = whole[::step]
        assert [r.threshold for r in got] == [t for t, _, _ in want]
        assert np.allclose([(r.precision, r.recall) for r in got], [(a, b) for _, a, b in want])


def test_single_class(spark):
    df = scored(spark, [1, 1, 1], [.2, .4, .9])
    table = metrics.score_table(df, "y", "p")
    row = metrics.ranking_metrics(table).first()
    assert row.roc_auc is None and row.pr_auc is None
    assert metrics.best_threshold(table).first().threshold == 0.5 and metrics.pr_curve(table).count() == 0
    zero = metrics.confusion(df, "y", "p", 0.95).first()
    assert (zero.precision, zero.recall, zero.f1) == (0, 0, 0)


def test_best_threshold_takes_the_lowest_of_equal_scores(spark):
    table = metrics.score_table(scored(spark, [1, 0, 1, 0, 0, 0], [.9, .8, .8, .3, .2, .1]), "y", "p")
    assert metrics.best_threshold(table).first().threshold == 0.8
    flat = metrics.score_table(scored(spark, [0, 1], [.5, .5]), "y", "p")
    assert metrics.best_threshold(flat).first().threshold == 0.5


def test_regression(spark):
    rng = np.random.default_rng(2)
    y = np.concatenate([np.zeros(5), rng.normal(100, 20, 200)])
    p = y + rng.normal(0, 5, len(y))
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    row = metrics.evaluate_regression(df, "y", "p", 90.0).first()
    e = np.abs(p - y)
    r2 = lambda q: 1 - ((y - q) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    nz = y != 0
    assert (row.mae, row.mse, row.rmse, row.r2) == pytest.approx((e.mean(), (e**2).mean(), (e**2).mean() ** .5, r2(p)))
    assert row.mape == pytest.approx(np.mean(e[nz] / np.abs(y[nz])) * 100)
    assert (row.median_abs_error, row.p95_abs_error, row.max_error) == pytest.approx(
        (np.median(e), np.percentile(e, 95), e.max()))
    assert row.mean_prediction_error == pytest.approx((p - y).mean())
    assert (row.baseline_mae, row.baseline_r2) == pytest.approx((np.abs(y - 90).mean(), r2(90.0)))
    zero = metrics.evaluate_regression(df.where("y = 0"), "y", "y").first()
    assert zero.mape is None and zero.r2 == 1.0 and zero.baseline_r2 is None


def test_error_columns_and_slices(spark):
    df = spark.createDataFrame([(0.0, 1.0, "a"), (4.0, 5.0, "a"), (2.0, 2.0, "b")], "y double, p double, g string")
    rows = metrics.with_regression_errors(df, "y", "p").collect()
    assert [(r.abs_error, r.error, r.pct_error) for r in rows] == [(1, 1, 0), (1, 1, 25), (0, 0, 0)]
    loss = metrics.with_log_loss(spark.createDataFrame([(1, 0.0), (0, 0.5)], "y int, p double"), "y", "p").collect()
    assert loss[0].log_loss == pytest.approx(-np.log(1e-15)) and loss[1].log_loss == pytest.approx(np.log(2))
    best = metrics.error_slices(df, "y", "p", dimensions=["g", "absent"], min_sample_size=1, top_k=1).first()
    assert best["values"] == {"g": "b"} and best.abs_difference == pytest.approx(2 / 3)
    for wrong in (dict(metric="log_loss"), dict(metric="abs_error", regression=False)):
        with pytest.raises(ValueError):
            metrics.error_slices(df, "y", "p", **wrong)


def test_running_totals_ascending(spark):
    df = spark.range(1000).selectExpr("cast(id as double) x", "id % 7 v")
    rows = running.running_totals(df, "x", ["v"], descending=False, single_task_rows=0, bucket_rows=10).orderBy("x").collect()
    assert [r.cum_v for r in rows] == list(np.cumsum([i % 7 for i in range(1000)]))
