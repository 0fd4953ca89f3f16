"""Jobs made of the operators: ingest, register, and a workspace that keeps tables and models together."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.operators import analysis, explain, metrics, models, profile, quality, scoring, search, slices, splits
from tabwise.plans.specs import DatasetConfig, DatasetSpec
from tabwise.sources import readers, writers

DATASETS_SCHEMA = (
    "dataset_id string, name string, entity_key string, time_key string, target string, row_count long, "
    "column_count int, data_start string, data_end string, table_path string, split_path string, "
    "train_rows long, validate_rows long, evaluation_rows long, config string, registered_at string"
)
MODELS_SCHEMA = "model_id string, dataset_id string, algorithm string, target_type string, path string, created string"


def ingest(spark: SparkSession, source: str, spec: DatasetSpec, table_path: str) -> DataFrame:
    """Read, validate, fail with every error in one message, write, and return the written table."""
    df = readers.read_source(spark, source, spec)
    quality.raise_on_errors(quality.validate(df, spec))
    writers.write_table(df, table_path)
    return spark.read.parquet(table_path)


def register_dataset(
    spark: SparkSession, config: DatasetConfig, source: str, root: str,
    fallback_shares: splits.Shares | None = None, ties: Sequence[str] | None = None,
) -> dict[str, Any]:
    """Ingest, split, write splits and profile, and append one metadata row. Sources may be shared by datasets."""
    spec = config.dataset
    table_path, split_path = f"{root}/tables/{spec.dataset_id}", f"{root}/splits/{spec.dataset_id}"
    df = ingest(spark, source, spec, table_path)
    divided = splits.split_dataset(df, spec, fallback_shares, ties=ties)
    writers.write_partitions(divided, split_path)
    sizes = {r["split"]: r["n"] for r in spark.read.parquet(split_path).groupBy("split").agg(
        F.count(F.lit(1)).alias("n")
    ).collect()}
    overview = profile.overview(df, spec).first().asDict()
    row = {
        "dataset_id": spec.dataset_id, "name": spec.name, "entity_key": spec.entity_key, "time_key": spec.time_key,
        "target": config.target.name if config.target else None, "row_count": overview["row_count"],
        "column_count": overview["column_count"], "data_start": overview.get("time_start"),
        "data_end": overview.get("time_end"), "table_path": table_path, "split_path": split_path,
        "train_rows": sizes.get("train", 0), "validate_rows": sizes.get("validate", 0),
        "evaluation_rows": sizes.get("evaluation", 0), "config": config.raw,
        "registered_at": datetime.now(timezone.utc).isoformat(timespec="microseconds"),
    }
    writers.write_table(profile.profile(spark.read.parquet(table_path), spec), f"{root}/profiles/{spec.dataset_id}")
    writers.append_metadata(spark, row, f"{root}/datasets", DATASETS_SCHEMA)
    return row


class Workspace:
    """Registered tables and trained models under one shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # datasets -----------------------------------------------------------------
    def register(self, config: DatasetConfig | str, source: str, **kw) -> dict[str, Any]:
        config = config if isinstance(config, DatasetConfig) else DatasetConfig.load(config)
        return register_dataset(self.spark, config, source, self.root, **kw)

    def _latest(self, table: str, key: str, stamp: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.root}/{table}")
        rest = [c for c in rows.columns if c != key]
        return rows.groupBy(key).agg(F.max_by(F.struct(*rest), stamp).alias("r")).select(key, "r.*")

    def datasets(self) -> DataFrame:
        return self._latest("datasets", "dataset_id", "registered_at")

    def models(self) -> DataFrame:
        return self._latest("models", "model_id", "created")

    def _row(self, rows: DataFrame, key: str, value: str):
        found = rows.where(F.col(key) == value).first()
        if found is None:
            raise ValueError(f"{key.removesuffix('_id')} {value!r} is not registered")
        return found

    def config(self, dataset_id: str) -> DatasetConfig:
        return DatasetConfig.from_json(self._row(self.datasets(), "dataset_id", dataset_id).config)

    def table(self, dataset_id: str) -> DataFrame:
        return self.spark.read.parquet(self._row(self.datasets(), "dataset_id", dataset_id).table_path)

    def split(self, dataset_id: str, name: str | None = None) -> DataFrame:
        path = self._row(self.datasets(), "dataset_id", dataset_id).split_path
        return writers.read_split(self.spark, path, name) if name else self.spark.read.parquet(path)

    def validate(self, dataset_id: str) -> DataFrame:
        return quality.validate(self.table(dataset_id), self.config(dataset_id).dataset)

    def profile(self, dataset_id: str) -> DataFrame:
        """The profile made at registration."""
        return self.spark.read.parquet(f"{self.root}/profiles/{dataset_id}")

    # queries ------------------------------------------------------------------
    def search(self, dataset_id: str, filters=None, **kw) -> search.SearchResult:
        return search.search(self.table(dataset_id), filters, spec=self.config(dataset_id).search, **kw)

    def contract(self, dataset_id: str) -> DataFrame:
        config = self.config(dataset_id)
        return profile.search_contract(self.table(dataset_id), config.dataset, config.search)

    def semantics(self, dataset_id: str) -> DataFrame:
        """The named filters a search over the table may use."""
        return profile.semantic_contract(self.table(dataset_id), self.config(dataset_id).search)

    def sample_rows(self, dataset_id: str, n: int = 20, **kw) -> DataFrame:
        return search.sample_rows(self.table(dataset_id), n, **kw)

    def slice(self, dataset_id: str, dimensions, metric: str, **kw) -> DataFrame:
        return analysis.slice_by(self.table(dataset_id), dimensions, metric, **kw)

    def aggregate(self, dataset_id: str, group_by, aggregations, **kw) -> DataFrame:
        return analysis.aggregate_by(self.table(dataset_id), group_by, aggregations, **kw)

    def compare(self, dataset_id: str, dimension: str, metric: str, **kw) -> DataFrame:
        return analysis.compare(self.table(dataset_id), dimension, metric, **kw)

    def interesting_slices(self, dataset_id: str, metric: str, **kw) -> DataFrame:
        spec = self.config(dataset_id).dataset
        return slices.interesting_slices(self.table(dataset_id), metric, spec=spec, **kw)

    # models -------------------------------------------------------------------
    def train(self, dataset_id: str, model_id: str, algorithm: str | None = None, params=None, **kw):
        """Train on the whole train partition; the threshold comes from the validate partition where there is one.

        Without one, validation is carved out of train. Evaluation rows are never read.
        """
        train, validate = (self.split(dataset_id, name).drop("split") for name in (splits.TRAIN, splits.VALIDATE))
        model = models.train_model(
            train, self.config(dataset_id), model_id, algorithm, params, from_partition=True,
            validation=None if validate.isEmpty() else validate, **kw
        )
        path = model.save(self.spark, f"{self.root}/artefacts/{model_id}")
        row = {
            "model_id": model_id, "dataset_id": dataset_id, "algorithm": model.algorithm,
            "target_type": "regression" if model.regression else "classification", "path": path,
            "created": model.created,
        }
        writers.append_metadata(self.spark, row, f"{self.root}/models", MODELS_SCHEMA)
        return model

    def model(self, model_id: str) -> models.TrainedModel:
        return models.TrainedModel.load(self.spark, self._row(self.models(), "model_id", model_id).path)

    def predict(self, model_id: str, requests: DataFrame | None = None, records: DataFrame | None = None, as_of=None):
        """Score records, (entity, as_of) requests, or every entity as of one time."""
        model = self.model(model_id)
        if records is not None:
            return scoring.score_records(model, records)
        table = self.table(model.config.dataset_id)
        if requests is not None and "as_of" in requests.columns:
            return scoring.score_requests(model, table, requests)
        if requests is not None:
            return scoring.score_entities(model, table, requests)
        return scoring.score_as_of(model, table, as_of)

    def evaluate(self, model_id: str, **kw) -> scoring.Evaluation:
        model = self.model(model_id)
        return scoring.evaluate(model, self.split(model.config.dataset_id), **kw)

    def evaluation_slices(self, model_id: str, metric: str = "abs_error", dimensions=None, **kw) -> DataFrame:
        model = self.model(model_id)
        scored = scoring.score_held_out(model, self.split(model.config.dataset_id))
        return metrics.error_slices(
            scored, model.config.target.name, "prediction", metric, dimensions, model.regression,
            spec=model.config.dataset, **kw,
        )

    def explain(self, model_id: str, as_of=None, records: DataFrame | None = None, top_k: int = 10) -> DataFrame:
        """Top drivers per explained row, one-hot columns grouped to their source."""
        model = self.model(model_id)
        spec = model.config.dataset
        if records is not None:
            from tabwise.operators import features

            keyed = scoring.with_placeholder_keys(records, spec)
            rows, _ = features.build_features(keyed, spec, model.config.features, model.fitted)
        else:
            rows = scoring.features_as_of(
                model.config, model.fitted, self.table(spec.dataset_id), as_of
            )
        keys = [k for k in spec.keys if k in rows.columns]
        impacts = explain.attribution(rows, model, keys)
        return explain.top_drivers(explain.group_onehot(impacts, keys).drop("categories"), keys, top_k)

    def predict_on_search(self, search_dataset_id: str, model_id: str, filters=None, as_of=None, **kw):
        model = self.model(model_id)
        return scoring.search_and_predict(
            self.table(search_dataset_id), model, self.table(model.config.dataset_id), as_of,
            filters=filters, spec=self.config(search_dataset_id).search, **kw,
        )
