"""Estimators and the training job, on pyspark.ml."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone
from math import sqrt
from typing import Any

from pyspark.ml.classification import GBTClassificationModel, LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import unwrap_udt

from tabwise.functions import layout as lay
from tabwise.functions import scalars
from tabwise.operators import encoding, features, metrics, splits, targets
from tabwise.operators.boosting import GBTClassifier, GBTRegressor
from tabwise.plans.specs import DatasetConfig
from tabwise.session import checkpoint_dir

# Features up to which Spark solves the normal equations.
NORMAL_FEATURES = 4096
LABEL, WEIGHT, VECTOR = "__label", "__weight", "__features"

# Hyperparameters of the two boosted-tree models.
BOOSTED_CLASSIFIER = {
    "maxIter": 200, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8",
    "minInstancesPerNode": 3, "seed": 42,
}
BOOSTED_REGRESSOR = {
    "maxIter": 300, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8",
    "minInstancesPerNode": 3, "seed": 42,
}
# Names users of gradient-boosting configurations may pass, and what they mean here.
ALIASES = {"xgboost": "boosted_classifier", "xgboost_regressor": "boosted_regressor"}
CLASSIFIERS = ("boosted_classifier", "logistic_regression")
REGRESSORS = ("boosted_regressor", "linear_regression")
SCALED = ("logistic_regression", "linear_regression")
LOADERS = {
    "boosted_classifier": GBTClassificationModel, "logistic_regression": LogisticRegressionModel,
    "boosted_regressor": GBTRegressionModel, "linear_regression": LinearRegressionModel,
}


def resolve_algorithm(name: str | None, regression: bool) -> str:
    """Default by task; otherwise the named one, checked against the task."""
    if name is None:
        return "boosted_regressor" if regression else "boosted_classifier"
    name = ALIASES.get(name, name)
    allowed = REGRESSORS if regression else CLASSIFIERS
    if name not in CLASSIFIERS + REGRESSORS:
        raise ValueError(f"unknown model {name!r}; use one of {', '.join(CLASSIFIERS + REGRESSORS)}")
    if name not in allowed:
        raise ValueError(f"model {name!r} does not fit the target; use one of {', '.join(allowed)}")
    return name


@dataclass
class TrainedModel:
    """A fitted Spark model with everything scoring needs; nothing is refitted later."""

    model_id: str
    algorithm: str
    config: DatasetConfig
    fitted: features.FittedFeatures
    medians: dict[str, float]
    scaling: dict[str, tuple[float, float]]
    estimator: Any
    threshold: float = 0.5
    metrics: dict[str, Any] = field(default_factory=dict)
    periods: dict[str, Any] = field(default_factory=dict)
    train_means: dict[str, float] = field(default_factory=dict)
    created: str = ""

    @property
    def feature_names(self) -> list[str]:
        return self.fitted.feature_names

    @property
    def regression(self) -> bool:
        return self.algorithm in REGRESSORS

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` (value or probability) and, for classifiers, ``predicted_label``."""
        ready = encoding.assemble(
            encoding.impute(df, self.medians), self.feature_names, VECTOR, self.scaling, self.fitted.sparse_features)
        kept = [scalars.named(c) for c in df.columns]
        scored = self.estimator.transform(ready)
        if self.regression:
            return scored.select(*kept, F.col("prediction").cast("double").alias("prediction"))
        probability = vector_to_array("probability")[1]
        return scored.select(*kept, probability.alias("__p")).select(
            *kept, F.col("__p").alias("prediction"),
            (F.col("__p") >= F.lit(self.threshold)).cast("int").alias("predicted_label"),
        )

    def importance(self, spark: SparkSession) -> DataFrame:
        """One row per feature: split importance of trees, coefficient (on scaled inputs) of linear models."""
        if self.algorithm in SCALED:
            weights = [float(c) for c in self.estimator.coefficients]
        else:
            weights = [float(w) for w in self.estimator.featureImportances.toArray()]
        return spark.createDataFrame(list(zip(self.fitted.expanded_names, weights)), "feature string, importance double")

    def sidecar(self) -> dict[str, Any]:
        return {
            "model_id": self.model_id, "algorithm": self.algorithm, "config": self.config.raw,
            "fitted": self.fitted.to_dict(), "medians": self.medians, "scaling": self.scaling,
            "threshold": self.threshold, "metrics": self.metrics, "periods": self.periods,
            "train_means": self.train_means, "created": self.created,
        }

    def save(self, spark: SparkSession, path: str) -> str:
        self.estimator.write().overwrite().save(f"{path}/estimator")
        row = [(json.dumps(self.sidecar(), default=str),)]
        spark.createDataFrame(row, "value string").write.mode("overwrite").text(f"{path}/model_json")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TrainedModel:
        raw = json.loads(spark.read.text(f"{path}/model_json", wholetext=True).first()[0])
        estimator = LOADERS[raw["algorithm"]].load(f"{path}/estimator")
        return cls(
            raw["model_id"], raw["algorithm"], DatasetConfig.from_json(raw["config"]),
            features.FittedFeatures.from_dict(raw["fitted"]), raw["medians"],
            {k: tuple(v) for k, v in raw["scaling"].items()}, estimator, raw["threshold"], raw["metrics"],
            raw["periods"], raw["train_means"], raw["created"],
        )


def ml_length(vector: str):
    """Length of a vector column, dense or sparse."""
    return F.coalesce(unwrap_udt(vector)["size"], F.size(unwrap_udt(vector)["values"]))


def fit_estimator(train: DataFrame, algorithm: str, params: Mapping[str, Any] | None = None):
    """Fit on ``VECTOR`` and ``LABEL`` columns."""
    params = dict(params or {})
    cols = {"featuresCol": VECTOR, "labelCol": LABEL}
    if algorithm == "boosted_classifier":
        checkpoint_dir(train.sparkSession)
        return GBTClassifier(**cols, **{**BOOSTED_CLASSIFIER, **params}).fit(train)
    if algorithm == "boosted_regressor":
        checkpoint_dir(train.sparkSession)
        return GBTRegressor(**cols, **{**BOOSTED_REGRESSOR, **params}).fit(train)
    if algorithm == "logistic_regression":
        inverse_penalty = params.pop("C", 1.0)
        counts = {int(r[0]): r[1] for r in train.groupBy(LABEL).count().collect()}  # two classes
        n = sum(counts.values())
        balance = {k: n / (2 * c) for k, c in counts.items()}
        weight = F.when(F.col(LABEL) == 1, F.lit(balance.get(1, 1.0))).otherwise(F.lit(balance.get(0, 1.0)))
        return LogisticRegression(
            **cols, weightCol=WEIGHT, regParam=1.0 / (inverse_penalty * n), elasticNetParam=0.0,
            standardization=False, maxIter=params.pop("maxIter", 1000), **params,
        ).fit(train.withColumn(WEIGHT, weight))
    alpha = params.pop("alpha", 1.0)
    n, spread, sample_spread, wide = train.agg(
        F.count(F.lit(1)), F.stddev_pop(LABEL), F.stddev_samp(LABEL), F.max(ml_length(VECTOR))).first()
    # The normal equations are exact and take one pass, up to the number of features their solver takes. Solvers scale the
    # label by its deviation, each by another one, so the penalty is given in that scale.
    if (wide or 0) <= NORMAL_FEATURES:
        solver = {"solver": "normal", "regParam": alpha / n * (spread or 1.0)}
    else:
        solver = {"solver": "l-bfgs", "maxIter": 1000, "tol": 1e-10, "regParam": alpha / n * (sample_spread or 1.0)}
    return LinearRegression(**cols, elasticNetParam=0.0, standardization=False, **{**solver, **params}).fit(train)


def labelled_features(
    df: DataFrame, config: DatasetConfig, layout: lay.Layout | None = None, max_categories=encoding.MAX_CATEGORIES,
    fitted: features.FittedFeatures | None = None, keep=(), cold_start: bool = False, split: str | None = None,
    sparse_from: int | None = None,
) -> tuple[DataFrame, features.FittedFeatures]:
    """Features and label on the same row, so duplicate keys never multiply rows.

    Windows look over the full history; ``cold_start`` restarts them in every split instead.
    """
    target = config.target
    if layout is None and config.dataset.temporal:
        layout = lay.measure(df, [config.dataset.entity_key], scalars.micros(config.dataset.time_key))
    labelled = targets.build_target(df, target, config.dataset, layout)
    keep = list(dict.fromkeys([*keep, target.name, *([split] if split else [])]))
    if fitted is None:
        train = labelled.where(F.col(split) == "train") if split else labelled
        fitted = features.fit_features(train, config.features, max_categories, sparse_from)
    if not (cold_start and split):
        return features.build_features(labelled, config.dataset, config.features, fitted, keep, layout)
    names = [r[0] for r in labelled.select(split).distinct().collect()]  # three splits at most
    parts = [
        features.build_features(labelled.where(F.col(split) == n), config.dataset, config.features, fitted, keep, layout)
        for n in names
    ]
    out, state = parts[0]
    for part, _ in parts[1:]:
        out = out.unionByName(part)
    return out, state


def train_model(
    df: DataFrame,
    config: DatasetConfig,
    model_id: str,
    algorithm: str | None = None,
    params: Mapping[str, Any] | None = None,
    ties: list[str] | None = None,
    from_partition: bool = False,
    layout: lay.Layout | None = None,
    cold_start: bool = False,
    validation: DataFrame | None = None,
    max_categories: int | None = encoding.MAX_CATEGORIES,
) -> TrainedModel:
    """Label → split → features fitted on train → impute → fit → threshold on validation → metrics.

    With ``validation`` all of ``df`` is trained on and those rows choose the threshold. With ``from_partition`` the
    rows are a train partition and only validation is carved out of it;
    otherwise the declared train / validation / test split is made here. Validation and test numbers are
    both reported, because the threshold is chosen on validation. Linear models take a column of very many categories
    as one sparse vector, so ``max_categories`` may be large for them.
    """
    if config.features is None or config.target is None:
        raise ValueError(f"dataset {config.dataset_id!r} has no features or no target section")
    spec, target = config.dataset, config.target
    algorithm = resolve_algorithm(algorithm, target.is_regression)
    if validation is not None:
        divided = df.withColumn("__split", F.lit("train")).unionByName(
            validation.withColumn("__split", F.lit("validation")))
    else:
        make = splits.carve_validation if from_partition else _three_way
        divided = make(df, spec.entity_key, spec.time_key, spec.split, ties=ties, out="__split")
    sparse_from = encoding.SPARSE_FROM if algorithm in SCALED else None
    built, fitted = labelled_features(
        divided, config, layout, max_categories, split="__split", cold_start=cold_start, sparse_from=sparse_from)
    rows = built.where(F.col(target.name).isNotNull()).persist()
    try:
        train = rows.where(F.col("__split") == "train")
        sparse = fitted.sparse_features
        plain = [n for n in fitted.feature_names if n not in sparse]
        medians = encoding.fit_medians(train, plain)
        filled = encoding.impute(train, medians)
        constants = encoding.fit_scaling(filled, plain) if plain else {}
        for index, names in sparse.items():
            shares = encoding.category_shares(filled, index, len(names))
            constants |= {n: (p, sqrt(p * (1 - p)) or 1.0) for n, p in zip(names, shares)}
        scaling = constants if algorithm in SCALED else {}
        ready = encoding.assemble(filled, fitted.feature_names, VECTOR, scaling, sparse).select(
            VECTOR, F.col(target.name).cast("double").alias(LABEL)
        )
        estimator = fit_estimator(ready, algorithm, params)
        model = TrainedModel(
            model_id, algorithm, config, fitted, medians, scaling, estimator,
            train_means={c: m for c, (m, _) in constants.items()},
            created=datetime.now(timezone.utc).isoformat(timespec="seconds"),
        )
        _measure(model, rows, target.name)
    finally:
        rows.unpersist()
    return model


def _three_way(df, entity_key, time_key, split, **kw):
    if time_key:
        return splits.chronological_split(df, entity_key, time_key, split, **kw)
    return splits.random_split(df, entity_key, split, **kw)


def _measure(model: TrainedModel, rows: DataFrame, label: str) -> None:
    """Periods and sizes in one pass; held-out rows are scored once, narrowed to label and prediction."""
    time = model.config.dataset.time_key or "__split"
    found = rows.groupBy("__split").agg(
        F.count(F.lit(1)).alias("n"), F.min(time).alias("start"), F.max(time).alias("end"), F.avg(label).alias("mean")
    ).collect()  # three splits
    sizes = {r["__split"]: r["n"] for r in found}
    means = {r["__split"]: r["mean"] for r in found}
    if model.config.dataset.time_key:
        model.periods = {r["__split"]: [str(r["start"]), str(r["end"])] for r in found}
    held_out = model.transform(rows.where(F.col("__split") != "train")).select("__split", label, "prediction").persist()
    part = lambda name: held_out.where(F.col("__split") == name)
    try:
        if not model.regression and sizes.get("validation"):
            table = metrics.score_table(part("validation"), label, "prediction")
            model.threshold = float(metrics.best_threshold(table).first()["threshold"])
        for name in ("validation", "test"):
            if sizes.get(name):
                result = (
                    metrics.evaluate_regression(part(name), label, "prediction", means.get("train"))
                    if model.regression
                    else metrics.evaluate_binary(part(name), label, "prediction", model.threshold)
                )
                model.metrics[name] = result.first().asDict()
    finally:
        held_out.unpersist()
    model.metrics["rows"] = sizes
