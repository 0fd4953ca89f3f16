"""Model metrics over scored rows.

Ranking metrics start from one row per distinct score, so equal scores are handled as ties and the
ordered pass runs over distinct values only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwise.functions import quantiles, running
from tabwise.functions.scalars import as_column
from tabwise.operators import slices
from tabwise.plans.specs import DatasetSpec
from tabwise.session import settle

# Clipping of probabilities in the log loss, points aimed at in a curve, F1 guard.
LOG_EPS, CURVE_POINTS, F1_EPS = 1e-15, 200, 1e-12
REGRESSION_ERRORS = ("abs_error", "error", "pct_error")
CLASSIFICATION_ERRORS = ("log_loss",)


def _safe(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def confusion(df: DataFrame, label: str, score: str, threshold: float | Column = 0.5) -> DataFrame:
    """One row: tn, fp, fn, tp, precision, recall, f1 at ``score >= threshold``; empty ratios are 0."""
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    actual, predicted = F.col(label) == 1, F.col(score) >= cut
    counts = df.agg(
        F.count_if(~actual & ~predicted).alias("tn"), F.count_if(~actual & predicted).alias("fp"),
        F.count_if(actual & ~predicted).alias("fn"), F.count_if(actual & predicted).alias("tp"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "tn", "fp", "fn", "tp", _safe(tp, tp + fp).alias("precision"), _safe(tp, tp + fn).alias("recall"),
        _safe(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def score_table(df: DataFrame, label: str, score: str) -> DataFrame:
    """Distinct scores with positives and negatives at, and at or above, each; ``seen`` counts from the top."""
    per_score = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(
        F.col(score).cast("double").alias("score")
    ).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"),
        F.lit(1).cast("long").alias("seen"),
    )
    # The ordered pass reads the distinct scores several times; the scoring behind them runs once.
    return running.running_totals(settle(per_score), "score", ["pos", "neg", "seen"]).select(
        "score", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
        F.col("cum_seen").alias("seen"),
    )


def _totals(table: DataFrame) -> DataFrame:
    return table.agg(
        F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"), F.count(F.lit(1)).alias("n_scores")
    )


def ranking_metrics(table: DataFrame) -> DataFrame:
    """One row: roc_auc (ties count half) and pr_auc (step-wise average precision); null for one class."""
    with_totals = table.crossJoin(F.broadcast(_totals(table)))  # one row of totals
    pos, neg, tp, fp = F.col("pos"), F.col("neg"), F.col("tp"), F.col("fp")
    all_pos, all_neg = F.max("all_pos"), F.max("all_neg")
    both = (all_pos > 0) & (all_neg > 0)
    wins = F.sum((pos * (F.col("all_neg") - fp) + pos * neg / 2).cast("double"))
    precision = F.sum(F.when(tp > 0, pos * tp / (tp + fp)))
    return with_totals.agg(
        F.when(both, wins / (all_pos.cast("double") * all_neg)).alias("roc_auc"),
        F.when(both, precision / all_pos).alias("pr_auc"),
    )


def _curve(table: DataFrame) -> DataFrame:
    tp, fp, total = F.col("tp"), F.col("fp"), F.col("all_pos")
    return table.crossJoin(F.broadcast(_totals(table))).select(
        F.col("score").alias("threshold"), (tp / (tp + fp)).alias("precision"),
        F.when(total > 0, tp / total).alias("recall"), "seen", "n_scores", "all_pos", "all_neg",
    )


def best_threshold(table: DataFrame) -> DataFrame:
    """One row: the threshold with the highest F1, lowest on ties; 0.5 when one class is absent."""
    p, r = F.col("precision"), F.col("recall")
    curve = _curve(table).where((F.col("all_pos") > 0) & (F.col("all_neg") > 0))
    ranked = curve.select("threshold", (2 * p * r / (p + r + F.lit(F1_EPS))).alias("f1"))
    best = ranked.agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("t"), F.max("f1").alias("f1"))
    return best.select(F.coalesce("t", F.lit(0.5)).alias("threshold"), "f1")


def pr_curve(table: DataFrame, points: int = CURVE_POINTS) -> DataFrame:
    """Curve in ascending thresholds with the closing point (precision 1, recall 0), thinned by a fixed step.

    The step is ``n // points``, so a thinned curve has between ``points`` and twice as many points.
    """
    curve = _curve(table).where((F.col("all_pos") > 0) & (F.col("all_neg") > 0))
    length = F.col("n_scores") + 1
    step = F.when(length > points, F.floor(length / points)).otherwise(F.lit(1)).cast("long")
    placed = curve.select(
        (F.col("n_scores") - F.col("seen")).alias("position"), "threshold", "precision", "recall", "n_scores"
    )
    closing = curve.groupBy("n_scores").agg(F.lit(1).alias("__one")).select(
        F.col("n_scores").alias("position"), F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), "n_scores",
    )
    every = placed.unionByName(closing).where(F.col("position") % step == 0)
    return every.select("position", "threshold", "precision", "recall")


def evaluate_binary(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row with all binary metrics."""
    table = score_table(df, label, score)
    return confusion(df, label, score, threshold).crossJoin(ranking_metrics(table)).withColumn(
        "threshold", F.lit(float(threshold))
    )


def _r2(sse: Column, sst: Column) -> Column:
    return F.when(sst > 0, 1 - sse / sst).otherwise(F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))


def evaluate_regression(
    df: DataFrame, actual: str, predicted: str, baseline: float | Column | None = None
) -> DataFrame:
    """One row: mae, mse, rmse, r2, mape, median/p95/max absolute error, mean error, and the constant baseline."""
    base = baseline if isinstance(baseline, Column) else F.lit(baseline).cast("double")
    rows = df.select(
        F.col(actual).cast("double").alias("y"), F.col(predicted).cast("double").alias("p"), base.alias("b")
    ).where(F.col("y").isNotNull() & F.col("p").isNotNull())
    y, p, b = F.col("y"), F.col("p"), F.col("b")
    errors = rows.select("y", "p", "b", F.abs(p - y).alias("e"))
    e = F.col("e")
    n, sst = F.count(F.lit(1)), F.var_pop(y) * F.count(y)
    sums = errors.agg(
        n.alias("n"), F.avg(e).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"),
        _r2(F.sum(e * e), sst).alias("r2"), (F.avg(F.when(y != 0, e / F.abs(y))) * 100).alias("mape"),
        F.max(e).alias("max_error"), F.avg(p - y).alias("mean_prediction_error"),
        F.max(b).alias("baseline_value"), F.avg(F.abs(y - b)).alias("baseline_mae"),
        F.sqrt(F.avg((y - b) * (y - b))).alias("baseline_rmse"),
        F.when(F.max(b).isNotNull(), _r2(F.sum((y - b) * (y - b)), sst)).alias("baseline_r2"),
    )
    spread = quantiles.group_quantiles(errors, [], "e", {"median_abs_error": 0.5, "p95_abs_error": 0.95})
    return sums.crossJoin(F.broadcast(spread))


def with_regression_errors(df: DataFrame, actual: str | Column, predicted: str | Column) -> DataFrame:
    y, p = as_column(actual).cast("double"), as_column(predicted).cast("double")
    return df.withColumns({
        "abs_error": F.abs(p - y), "error": p - y,
        "pct_error": F.when(y != 0, F.abs(p - y) / F.abs(y) * 100).when(y == 0, F.lit(0.0)),
    })


def with_log_loss(df: DataFrame, label: str | Column, probability: str | Column) -> DataFrame:
    y = as_column(label).cast("double")
    p = F.least(F.greatest(as_column(probability), F.lit(LOG_EPS)), F.lit(1 - LOG_EPS))
    return df.withColumn("log_loss", -(y * F.log(p) + (1 - y) * F.log(1 - p)))


def error_slices(
    scored: DataFrame,
    actual: str,
    predicted: str,
    metric: str = "abs_error",
    dimensions: Sequence[str] | None = None,
    regression: bool = True,
    min_sample_size: int = 50,
    max_dimensions: int = 3,
    top_k: int = 20,
    spec: DatasetSpec | None = None,
) -> DataFrame:
    """Slices whose mean error deviates most; dimensions default to declared categorical features."""
    allowed = REGRESSION_ERRORS if regression else CLASSIFICATION_ERRORS
    if metric not in allowed:
        raise ValueError(f"unsupported metric {metric!r}; use one of {', '.join(allowed)}")
    add = with_regression_errors if regression else with_log_loss
    return slices.interesting_slices(
        add(scored, actual, predicted), metric, dimensions, min_sample_size, max_dimensions, "mean",
        top_k=top_k, spec=spec,
    )
