"""Training, scoring, evaluation and explanation on the events and orders tables."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabwise.operators import encoding, explain, models, scoring, splits
from tabwise.plans.specs import DatasetConfig
from tabwise.queries.ranking import predicted_orders
from tabwise.queries.registry import register, rounded, table

RIDGE_SQL = """
    WITH x AS (SELECT l_orderkey, count(*)::DOUBLE AS lines, sum(l_extendedprice * (1 - l_discount)) AS total
               FROM lineitem GROUP BY 1),
    d AS (SELECT o_orderkey, o_totalprice AS y, lines, total FROM orders JOIN x ON l_orderkey = o_orderkey),
    m AS (SELECT count(*)::DOUBLE AS n, avg(y) AS ym, avg(lines) AS a, stddev_pop(lines) AS sa, avg(total) AS b,
                 stddev_pop(total) AS sb, corr(lines, total) AS rho, covar_pop(lines, y) / stddev_pop(lines) AS c1,
                 covar_pop(total, y) / stddev_pop(total) AS c2 FROM d),
    w AS (SELECT *, ((n + 1) * n * c1 - n * rho * n * c2) / ((n + 1) * (n + 1) - n * rho * n * rho) AS w1,
                 ((n + 1) * n * c2 - n * rho * n * c1) / ((n + 1) * (n + 1) - n * rho * n * rho) AS w2 FROM m)"""


@register("train_ridge_score", f"""
    {RIDGE_SQL} SELECT o_orderkey, round(ym + w1 * (lines - a) / sa + w2 * (total - b) / sb, 2) AS prediction FROM d, w""")
def train_ridge_score(spark, folder):
    """Ridge regression (penalty 1 on standardised inputs) against its closed form."""
    rows = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).cast("double").alias("lines"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("total"),
    ).join(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    names = ["lines", "total"]
    scaling = encoding.fit_scaling(rows, names)
    ready = encoding.assemble(rows, names, models.VECTOR, scaling).withColumn(models.LABEL, F.col("o_totalprice"))
    fitted = models.fit_estimator(ready, "linear_regression")
    return rounded(fitted.transform(ready).select("o_orderkey", "prediction"), 2)


def purchase_config(*features: str) -> DatasetConfig:
    every = {
        "value": {"transforms": ["current", {"mean": {"windows": ["6h", "24h"]}}, {"std": {"windows": ["24h"]}},
                                 {"slope": {"windows": ["24h"]}}]},
        "kind": {"column": "event_type", "transforms": ["categorical"]},
        "clock": {"column": "ts", "transforms": ["hour_of_day", "day_of_week"]},
    }
    return DatasetConfig.read({
        "dataset": {
            "dataset_id": "events", "entity_key": "user_id", "time_key": "ts",
            "columns": {"user_id": {"type": "numeric", "role": "identifier"}, "ts": {"type": "timestamp"},
                        "event_type": {"type": "categorical"}, "value": {"type": "numeric"}},
        },
        "features": {n: every[n] for n in (features or every)},
        "target": {"name": "purchase_24h", "type": "future_event", "source_column": "event_type", "horizon": "24h",
                   "positive_class": "purchase"},
    })


def amount_config() -> DatasetConfig:
    return DatasetConfig.read({
        "dataset": {"dataset_id": "amounts", "entity_key": "o_custkey", "time_key": "o_orderdate",
                    "columns": {"o_orderpriority": {"type": "categorical"}, "o_orderstatus": {"type": "categorical"}}},
        "features": {"p": {"transforms": ["current"]},
                     "o_orderpriority": {"transforms": ["categorical"]}, "o_orderstatus": {"transforms": ["categorical"]}},
        "target": {"name": "y", "type": "regression", "source_column": "y"},
    })


TRAINED: dict[tuple, models.TrainedModel] = {}


def trained(spark, folder, algorithm, features=()):
    """Events and a model of them, which is fitted once per session."""
    events = table(spark, folder, "events")
    key = spark.sparkContext.applicationId, folder, algorithm, features
    if key not in TRAINED:
        TRAINED[key] = models.train_model(
            events, purchase_config(*features), f"purchase-{algorithm}", algorithm, ties=["event_id"])
    return events, TRAINED[key]


@register("train_gbt_score")
def train_gbt_score(spark, folder):
    """Boosted trees on the event features, then every user as of the latest time."""
    events, model = trained(spark, folder, "boosted_classifier")
    return rounded(scoring.score_as_of(model, events), 6)


@register("train_logistic_score")
def train_logistic_score(spark, folder):
    events, model = trained(spark, folder, "logistic_regression")
    return rounded(scoring.score_as_of(model, events), 6)


@register("score_requests")
def score_requests(spark, folder):
    """Every (user, order date of the month) request in one job, with an error text where history is missing."""
    events, model = trained(spark, folder, "logistic_regression", features=("value",))
    days = events.select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("as_of")).distinct()
    firsts = events.groupBy("user_id").agg(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz").alias("as_of"))
    asked = events.select("user_id", F.date_trunc("week", "ts").cast("timestamp_ntz").alias("as_of")).distinct()
    return rounded(scoring.score_requests(model, events, asked.unionByName(firsts).distinct()), 6)


@register("evaluate_holdout")
def evaluate_holdout(spark, folder):
    """Metrics on the newest 15 percent, overall and for one event type."""
    events = table(spark, folder, "events")
    divided = splits.assign_split(events, "user_id", "ts", (0.70, 0.15, 0.15), ties=["event_id"])
    train = divided.where(F.col("split") == "train").drop("split")
    model = models.train_model(
        train, purchase_config(), "holdout", "logistic_regression", ties=["event_id"], from_partition=True)
    result = scoring.evaluate(model, divided, filters={"event_type": "click"})
    part = lambda df, name: df.withColumn("rows", F.lit(name))
    return rounded(part(result.overall, "all").unionByName(part(result.filtered, "click")), 6)


@register("feature_importance")
def feature_importance(spark, folder):
    _, model = trained(spark, folder, "boosted_classifier")
    return rounded(model.importance(spark), 6)


@register("tree_attribution")
def tree_attribution(spark, folder):
    """Shapley values of every user's latest prediction, grouped to source columns, three strongest each."""
    events, model = trained(spark, folder, "boosted_classifier")
    rows = scoring.features_as_of(model.config, model.fitted, events)
    grouped = explain.group_onehot(explain.attribution(rows, model, ["user_id"]), ["user_id"]).drop("categories")
    return rounded(explain.top_drivers(grouped, ["user_id"], 3), 6)


@register("staged_scores")
def staged_scores(spark, folder):
    """The same users scored by models that see more and more of the inputs."""
    stages = {}
    for name, inputs in {"stage_a": ("value",), "stage_b": ("value", "kind"), "stage_c": ()}.items():
        events, model = trained(spark, folder, "logistic_regression", features=inputs)
        stages[name] = scoring.score_as_of(model, events)
    return rounded(scoring.staged_scores(stages, "user_id"), 6)


@register("train_gbt_regression")
def train_gbt_regression(spark, folder):
    """Boosted regression of order totals; validation and test metrics."""
    rows = predicted_orders(spark, folder).join(
        table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey")
    model = models.train_model(rows, amount_config(), "amounts", None, ties=["o_orderkey"])
    parts = [(n, float(m["mae"]), float(m["rmse"]), float(m["r2"]), float(m["baseline_mae"]))
             for n, m in model.metrics.items() if n in ("validation", "test")]
    return spark.createDataFrame(parts, "split string, mae double, rmse double, r2 double, baseline_mae double")


@register("attribution_adds_up", "SELECT DISTINCT user_id, TRUE AS adds_up FROM events")
def attribution_adds_up(spark, folder):
    """Base value and impacts of every user's latest row against the raw output of the boosted trees."""
    events, model = trained(spark, folder, "boosted_classifier")
    rows = scoring.features_as_of(model.config, model.fitted, events)
    summed = explain.tree_attribution(rows, model, ["user_id"]).groupBy("user_id").agg(
        (F.sum("impact") + F.max("base_value")).alias("explained"))
    scored = model.transform(rows).select("user_id", "prediction")
    margin = F.log(F.col("prediction") / (1 - F.col("prediction"))) / 2  # boosted trees give half the log odds
    return scored.join(summed, "user_id").select("user_id", (F.abs(margin - F.col("explained")) < 1e-6).alias("adds_up"))


@register("importance_sums", """
    SELECT 1.0::DOUBLE AS total, 0.0::DOUBLE AS below_zero, 7 + count(DISTINCT event_type) AS n_features FROM events""")
def importance_sums(spark, folder):
    """Importances are shares: none below zero, together one, one per feature."""
    _, model = trained(spark, folder, "boosted_classifier")
    return model.importance(spark).agg(
        F.round(F.sum("importance"), 9).alias("total"), F.sum(F.least("importance", F.lit(0.0))).alias("below_zero"),
        F.count(F.lit(1)).alias("n_features"))


@register("logistic_optimum", """
    SELECT count(*) AS n_rows, TRUE AS at_optimum FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def logistic_optimum(spark, folder):
    """The gradient of the penalised, class-balanced loss is zero at the fitted coefficients."""
    rows = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).cast("double").alias("lines"), F.avg("l_quantity").alias("quantity"),
    ).join(table(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_orderpriority") < "3").cast("double").alias(models.LABEL)), "o_orderkey")
    names = ["lines", "quantity"]
    ready = encoding.assemble(rows, names, models.VECTOR, encoding.fit_scaling(rows, names)).persist()
    fitted = models.fit_estimator(ready, "logistic_regression")
    label, n = F.col(models.LABEL), ready.count()
    positive = ready.agg(F.sum(label)).first()[0]
    weight = F.when(label == 1, n / (2 * positive)).otherwise(n / (2 * (n - positive)))
    off = weight * (vector_to_array(F.col("probability"))[1] - label)
    x = vector_to_array(F.col(models.VECTOR))
    scored = fitted.transform(ready)
    penalty = [0.0, *[float(c) / n for c in fitted.coefficients]]
    slopes = [F.avg(off * (F.lit(1.0) if j == 0 else x[j - 1])) + F.lit(p) for j, p in enumerate(penalty)]
    steepest = F.greatest(*[F.abs(g) for g in slopes])
    return scored.agg(F.count(F.lit(1)).alias("n_rows"), (steepest < 1e-4).alias("at_optimum"))
