"""Metrics over scored rows, error slices, search → score → rank."""

from pyspark.sql import functions as F

from tabwise.operators import metrics as ops
from tabwise.operators import scoring
from tabwise.operators.filters import Filter
from tabwise.operators.search import Sort
from tabwise.plans import durations
from tabwise.plans.specs import DatasetConfig
from tabwise.queries.analysis import flat
from tabwise.queries.registry import register, rounded, steady, table

# Labelled documents; the score is a formula of the length, rounded so that scores tie.
SCORED_SQL = """s AS (SELECT doc_id, quality AS y, round(n_chars / (n_chars + 1500.0), 2) AS p
                FROM labels JOIN documents USING (doc_id))"""
# One row per distinct score with counts at or above it.
TABLE_SQL = SCORED_SQL + """,
    g AS (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg FROM s GROUP BY 1),
    k AS (SELECT p, pos, neg, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER () AS all_pos,
                 sum(neg) OVER () AS all_neg, row_number() OVER (ORDER BY p) - 1 AS position, count(*) OVER () AS n
          FROM g WINDOW d AS (ORDER BY p DESC))"""
CURVE_SQL = TABLE_SQL + """,
    c AS (SELECT p, position, n, tp / (tp + fp) AS prec, tp / all_pos AS rec FROM k)"""


def scored_documents(spark, folder):
    n = F.col("n_chars")
    docs = table(spark, folder, "documents").select("doc_id", steady(n / (n + 1500.0), 2).alias("p"))
    return table(spark, folder, "labels").select("doc_id", F.col("quality").alias("y")).join(docs, "doc_id")


@register("metrics_binary", f"""
    WITH {SCORED_SQL}, m AS (SELECT count(*) FILTER (y = 0 AND p < 0.4) AS tn, count(*) FILTER (y = 0 AND p >= 0.4) AS fp,
        count(*) FILTER (y = 1 AND p < 0.4) AS fn, count(*) FILTER (y = 1 AND p >= 0.4) AS tp FROM s)
    SELECT tn, fp, fn, tp, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS "precision",
           round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall,
           round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM m""")
def metrics_binary(spark, folder):
    return rounded(ops.confusion(scored_documents(spark, folder), "y", "p", 0.4))


@register("roc_auc", f"""
    WITH {SCORED_SQL}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM s)
    SELECT round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0)
           / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 4) AS roc_auc FROM r""")
def roc_auc(spark, folder):
    scores = ops.score_table(scored_documents(spark, folder), "y", "p")
    return rounded(ops.ranking_metrics(scores).select("roc_auc"))


@register("pr_auc", f"WITH {TABLE_SQL} SELECT round(sum(pos / all_pos * tp / (tp + fp)), 4) AS pr_auc FROM k")
def pr_auc(spark, folder):
    scores = ops.score_table(scored_documents(spark, folder), "y", "p")
    return rounded(ops.ranking_metrics(scores).select("pr_auc"))


@register("best_threshold", f"""
    WITH {CURVE_SQL} SELECT p AS threshold, round(2 * prec * rec / (prec + rec + 1e-12), 4) AS f1 FROM c
    ORDER BY 2 * prec * rec / (prec + rec + 1e-12) DESC, p LIMIT 1""")
def best_threshold(spark, folder):
    return rounded(ops.best_threshold(ops.score_table(scored_documents(spark, folder), "y", "p")))


@register("pr_curve", f"""
    WITH {CURVE_SQL}, u AS (SELECT position, p AS threshold, prec AS "precision", rec AS recall, n FROM c
        UNION ALL SELECT n, NULL, 1.0, 0.0, n FROM c GROUP BY n)
    SELECT position, threshold, round("precision", 4) AS "precision", round(recall, 4) AS recall FROM u
    WHERE position % (CASE WHEN n + 1 > 20 THEN (n + 1) // 20 ELSE 1 END) = 0""")
def pr_curve(spark, folder):
    return rounded(ops.pr_curve(ops.score_table(scored_documents(spark, folder), "y", "p"), points=20))


# Order totals predicted from the sum of their line items.
ORDERS_SQL = """s AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice AS y, total * 1.5 AS p FROM orders
    JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS total FROM lineitem GROUP BY 1)
    ON l_orderkey = o_orderkey)"""


def predicted_orders(spark, folder):
    totals = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("total"))
    return table(spark, folder, "orders").join(totals, "o_orderkey").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_totalprice").alias("y"),
        (F.col("total") * 1.5).alias("p"))


@register("metrics_regression", f"""
    WITH {ORDERS_SQL} SELECT count(*) AS n, round(avg(abs(p - y)), 2) AS mae, round(sqrt(avg((p - y) * (p - y))), 2) AS rmse,
        round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 4) AS r2,
        round(avg(CASE WHEN y <> 0 THEN abs((p - y) / y) END) * 100, 2) AS mape,
        round(median(abs(p - y)), 2) AS median_abs_error, round(quantile_cont(abs(p - y), 0.95), 2) AS p95_abs_error,
        round(max(abs(p - y)), 2) AS max_error, round(avg(p - y), 2) AS mean_prediction_error FROM s""")
def metrics_regression(spark, folder):
    measured = ops.evaluate_regression(predicted_orders(spark, folder), "y", "p")
    money = ["mae", "rmse", "mape", "median_abs_error", "p95_abs_error", "max_error", "mean_prediction_error"]
    return measured.select("n", steady("r2", 4).alias("r2"), *[steady(c, 2).alias(c) for c in money])


@register("baseline", f"""
    WITH {ORDERS_SQL}, t AS (SELECT avg(o_totalprice) AS b FROM orders WHERE o_orderstatus = 'F')
    SELECT round(any_value(b), 2) AS baseline_value, round(avg(abs(y - b)), 2) AS baseline_mae,
           round(sqrt(avg((y - b) * (y - b))), 2) AS baseline_rmse,
           round(1 - sum((y - b) * (y - b)) / (var_pop(y) * count(*)), 4) AS baseline_r2 FROM s, t""")
def baseline(spark, folder):
    """Constant predictor: the mean of finished orders."""
    mean = table(spark, folder, "orders").where(F.col("o_orderstatus") == "F").agg(F.avg("o_totalprice")).first()[0]
    found = ops.evaluate_regression(predicted_orders(spark, folder), "y", "p", mean)
    return found.select(*[steady(f"baseline_{c}", 4 if c == "r2" else 2).alias(f"baseline_{c}")
                          for c in ("value", "mae", "rmse", "r2")])


@register("error_columns", f"""
    WITH {ORDERS_SQL} SELECT o_orderkey, round(abs(p - y), 4) AS abs_error, round(p - y, 4) AS error,
        round(CASE WHEN y <> 0 THEN abs(p - y) / abs(y) * 100 ELSE 0 END, 4) AS pct_error FROM s""")
def error_columns(spark, folder):
    rows = ops.with_regression_errors(predicted_orders(spark, folder), "y", "p")
    return rounded(rows.select("o_orderkey", "abs_error", "error", "pct_error"))


@register("log_loss", f"""
    WITH {SCORED_SQL}, c AS (SELECT doc_id, y, least(greatest(p, 1e-15), 1 - 1e-15) AS p FROM s)
    SELECT doc_id, round(-(y * ln(p) + (1 - y) * ln(1 - p)), 4) AS log_loss FROM c""")
def log_loss(spark, folder):
    return rounded(ops.with_log_loss(scored_documents(spark, folder), "y", "p").select("doc_id", "log_loss"))


@register("error_slices", f"""
    WITH {ORDERS_SQL}, e AS (SELECT *, abs(p - y) AS x FROM s), o AS (SELECT avg(x) AS overall FROM e),
    g AS (SELECT grouping(o_orderstatus, o_orderpriority) AS set_id,
                 2 - bit_count(grouping(o_orderstatus, o_orderpriority)) AS n_dimensions,
                 concat_ws(',', CASE WHEN grouping(o_orderstatus) = 0 THEN 'o_orderstatus=' || o_orderstatus END,
                     CASE WHEN grouping(o_orderpriority) = 0 THEN 'o_orderpriority=' || o_orderpriority END) AS slice,
                 count(*) AS row_count, avg(x) AS m, median(x) AS med, stddev_samp(x) AS sd
          FROM e GROUP BY CUBE (o_orderstatus, o_orderpriority))
    SELECT slice, CAST(n_dimensions AS INTEGER) AS n_dimensions, row_count, round(m, 4) AS metric_value,
           round(med, 4) AS metric_median, round(sd, 4) AS metric_std, round(overall, 4) AS overall_baseline,
           round(m - overall, 4) AS difference, round(abs(m - overall), 4) AS abs_difference FROM g, o
    WHERE n_dimensions > 0 AND row_count >= 50 ORDER BY abs(m - overall) DESC, n_dimensions, set_id DESC LIMIT 10""")
def error_slices(spark, folder):
    return flat(ops.error_slices(
        predicted_orders(spark, folder), "y", "p", dimensions=["o_orderstatus", "o_orderpriority"], top_k=10))


RECENT = DatasetConfig.read({
    "dataset": {"dataset_id": "demand", "entity_key": "l_partkey", "time_key": "l_shipdate"},
    "features": {"l_quantity": {"transforms": [{"mean": {"windows": ["26w"]}}]}},
})
SCORE_SQL = f"""f AS (SELECT l_partkey, l_shipdate, avg(l_quantity) OVER (PARTITION BY l_partkey
        ORDER BY epoch_us(l_shipdate) RANGE BETWEEN {durations.micros('26w') - 1} PRECEDING AND CURRENT ROW) AS m
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-06-30'),
    s AS (SELECT l_partkey AS p_partkey, arg_max(m, l_shipdate) / 50 AS prediction FROM f GROUP BY 1)"""


def recent_scores(spark, folder):
    """Score as of a date: mean quantity of the last half year at each part's last shipment, as a share of 50."""
    rows = scoring.features_as_of(RECENT, None, table(spark, folder, "lineitem"), "1998-06-30")
    return rows.select(F.col("l_partkey").alias("p_partkey"), (F.col("l_quantity_mean_26w") / 50).alias("prediction"))


@register("search_predict_rank", f"""
    WITH {SCORE_SQL}, c AS (SELECT p_partkey, p_name, p_size FROM part WHERE p_size >= 25 AND p_brand IN ('Brand#3', 'Brand#4')
        ORDER BY p_size DESC NULLS FIRST, p_partkey LIMIT 40)
    SELECT p_partkey, p_name, p_size, round(prediction, 4) AS prediction,
           CASE WHEN prediction >= 0.5 THEN 'risk' WHEN prediction IS NOT NULL THEN 'safe' END AS prediction_label
    FROM c LEFT JOIN s USING (p_partkey)""")
def search_predict_rank(spark, folder):
    found = scoring.rank_search(
        table(spark, folder, "part"), recent_scores(spark, folder), "p_partkey",
        [Filter("p_size", "gte", 25), Filter("p_brand", "in", ["Brand#3", "Brand#4"])], [Sort("p_size", True)], 40,
        ["p_partkey", "p_name", "p_size"], threshold=0.5,
    )
    return rounded(found.rows.drop(scoring.ERROR))


@register("rank_before_limit", f"""
    WITH {SCORE_SQL} SELECT p_partkey, p_size, round(prediction, 4) AS prediction FROM part LEFT JOIN s USING (p_partkey)
    WHERE p_size >= 25 ORDER BY prediction DESC NULLS LAST, p_partkey LIMIT 30""")
def rank_before_limit(spark, folder):
    found = scoring.rank_search(
        table(spark, folder, "part"), recent_scores(spark, folder), "p_partkey", [Filter("p_size", "gte", 25)],
        limit=30, columns=["p_partkey", "p_size"], rank_before_limit=True,
    )
    return rounded(found.rows.drop(scoring.ERROR))
