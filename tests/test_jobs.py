import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise.operators import splits
from tabwise.operators.filters import Filter
from tabwise.plans.jobs import Workspace, ingest
from tabwise.plans.specs import DatasetConfig, DatasetSpec, SplitSpec
from tabwise.sources import readers, writers

SERIES = {
    "dataset": {
        "dataset_id": "supply", "entity_key": "machine_id", "time_key": "timestamp",
        "columns": {
            "machine_id": {"type": "categorical", "role": "identifier"},
            "timestamp": {"type": "timestamp", "role": "identifier"}, "kind": {"type": "categorical"},
            "value": {"type": "numeric"}, "failure": {"type": "boolean", "role": "event"},
        },
        "split": {"train": 0.7, "validation": 0.1, "test": 0.2},
    },
    "features": {"value": {"transforms": ["current", {"mean": {"windows": ["3h", "1d"]}}]},
                 "kind": {"transforms": ["categorical"]}},
    "target": {"name": "soon", "type": "future_event", "source_column": "failure", "horizon": "12h"},
}
CATALOGUE = {
    "dataset": {"dataset_id": "machines", "entity_key": "machine_id", "columns": {
        "machine_id": {"type": "categorical", "role": "identifier"}, "size": {"type": "numeric"}},
        "split": {"train": 1.0}},
    "search": {"searchable_fields": {"size": {"field": "size", "aliases": ["scale"]}}},
}


def test_csv_is_coerced_without_inference(spark, tmp_path):
    text = "machine_id,timestamp,kind,value,failure,extra\na,2024-01-01 10:00:00,x,1.5,1,q\nb,not a time,,oops,maybe,r\nc,2024-01-02,y,2,true,s\n"
    path = tmp_path / "in.csv"
    path.write_text(text)
    df = readers.read_source(spark, str(path), DatasetConfig.read(SERIES).dataset)
    assert dict(df.dtypes) == {"machine_id": "string", "timestamp": "timestamp", "kind": "string", "value": "double",
                               "failure": "tinyint", "extra": "string"}
    a, b, c = df.orderBy("machine_id").collect()
    assert (a.timestamp, a.value, a.failure) == (datetime(2024, 1, 1, 10), 1.5, 1)
    assert (b.timestamp, b.kind, b.value, b.failure) == (None, None, None, None)
    assert (c.timestamp, c.failure) == (datetime(2024, 1, 2), 1)


def test_other_formats_are_rejected(spark):
    with pytest.raises(ValueError, match="unsupported source format"):
        readers.read_source(spark, "/tmp/x.xlsx")


def test_ingest_fails_with_every_error(spark, sensors, tmp_path):
    sensors.drop("kind", "value").write.parquet(str(tmp_path / "s.parquet"))
    with pytest.raises(ValueError, match="kind.*value"):
        ingest(spark, str(tmp_path / "s.parquet"), DatasetConfig.read(SERIES).dataset, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_time_bounds_reach_the_scan(spark, sensors, tmp_path):
    sensors.write.parquet(str(tmp_path / "t"))
    rows = readers.recent(spark.read.parquet(str(tmp_path / "t")), "timestamp", "2024-01-01 12:00:00", 3_600_000_000)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp" in plan and "LessThanOrEqual(timestamp" in plan
    found = [r.timestamp for r in rows.collect()]
    assert found and min(found) >= datetime(2024, 1, 1, 11) and max(found) <= datetime(2024, 1, 1, 12)


def test_csv_sink(spark, catalogue, tmp_path):
    writers.write_csv(catalogue, str(tmp_path / "c.csv"))
    assert readers.read_source(spark, str(tmp_path / "c.csv")).count() == 6


@pytest.fixture(scope="module")
def workspace(spark, sensors, tmp_path_factory):
    root = tmp_path_factory.mktemp("workspace")
    sensors.write.parquet(str(root / "series.parquet"))
    (root / "machines.csv").write_text("machine_id,size\n" + "".join(f"m{i},{i}\n" for i in range(6)) + "ghost,9\n")
    config = root / "dataset.yaml"
    config.write_text(json.dumps(SERIES))  # JSON is YAML
    ws = Workspace(spark, str(root / "ws"))
    ws.register(str(config), str(root / "series.parquet"), ties=["row_id"])
    ws.register(DatasetConfig.read(CATALOGUE), str(root / "machines.csv"))
    ws.train("supply", "risk", "logistic_regression", ties=["row_id"])
    return ws


def test_registration(workspace):
    rows = {r.dataset_id: r for r in workspace.datasets().collect()}
    supply, machines = rows["supply"], rows["machines"]
    # Sizes follow floating-point shares normalised when read and when used: 720 * 0.7 lands just below 504.
    train, evaluation, validate = splits.normalize(*splits.resolve_shares(SplitSpec(train=0.7, validation=0.1, test=0.2)))
    ends = int(720 * train), int(720 * (train + validate))
    assert ends == (503, 576)
    assert (supply.row_count, supply.train_rows, supply.validate_rows, supply.evaluation_rows) == (720, 503, 73, 144)
    assert supply.target == "soon" and supply.data_start.startswith("2024-01-01")
    assert (machines.row_count, machines.train_rows, machines.evaluation_rows) == (7, 7, 0)
    assert workspace.split("supply", "evaluation").count() == 144
    with pytest.raises(ValueError, match="not registered"):
        workspace.table("nope")


def test_empty_splits_have_no_path(spark, tmp_path):
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 8, "train").otherwise("evaluation"))
    paths = writers.write_partitions(df, str(tmp_path / "p"))
    assert paths["validate"] is None and paths["train"].endswith("split=train")
    scan = writers.read_split(spark, str(tmp_path / "p"), "train")
    assert "PartitionFilters: [isnotnull(split" in scan._jdf.queryExecution().executedPlan().toString()


def test_registering_again_replaces(spark, workspace, tmp_path):
    spark.createDataFrame([("m1", 4.0)], "machine_id string, size double").write.parquet(str(tmp_path / "m.parquet"))
    other = DatasetConfig.read({**CATALOGUE, "dataset": {**CATALOGUE["dataset"], "dataset_id": "twice"}})
    for _ in range(2):
        workspace.register(other, str(tmp_path / "m.parquet"))
    assert workspace.datasets().where("dataset_id = 'twice'").count() == 1


def test_queries_through_the_workspace(workspace):
    assert workspace.validate("machines").count() == 0
    assert workspace.profile("supply").count() == 5
    assert workspace.search("machines", [Filter("scale", "gte", 3)]).matched() == 4
    assert workspace.contract("machines").first()["max"] == 9.0
    assert workspace.sample_rows("supply", 3, filters={"kind": "a"}).count() == 3
    assert workspace.slice("supply", ["kind"], "value").count() == 3
    assert workspace.aggregate("supply", ["kind"], {"value": "max", "row_id": "count"}).columns == ["kind", "value_max", "row_id_count"]
    assert workspace.compare("supply", "kind", "value").count() == 3
    assert workspace.interesting_slices("supply", "value", min_sample_size=10).first().dimensions == ["kind"]


def test_model_through_the_workspace(spark, workspace):
    assert workspace.models().first().algorithm == "logistic_regression"
    assert workspace.predict("risk").count() == 6
    asked = spark.createDataFrame([("m0", datetime(2024, 1, 2))], "machine_id string, as_of timestamp")
    assert workspace.predict("risk", asked).first().prediction is not None
    assert workspace.predict("risk", asked.select("machine_id")).count() == 1
    assert workspace.evaluate("risk").overall.first().roc_auc is not None
    assert workspace.evaluation_slices("risk", "log_loss", min_sample_size=5).first().dimensions == ["kind"]
    drivers = workspace.explain("risk", top_k=2)
    assert drivers.where("ranking = 'absolute'").count() == 12
    assert {"kind", "value"} <= {r.feature for r in drivers.collect()}
    ranked = workspace.predict_on_search("machines", "risk", [Filter("size", "gte", 4)]).rows.collect()
    assert [r.machine_id for r in ranked][-1] == "ghost" and len(ranked) == 3


def test_training_reads_the_train_partition_only(workspace):
    model = workspace.model("risk")
    assert model.metrics["rows"] == {"train": 503, "validation": 73} and "test" not in model.metrics


def test_unregistered_model_and_missing_sections(workspace):
    with pytest.raises(ValueError, match="model 'nope' is not registered"):
        workspace.model("nope")
    with pytest.raises(ValueError, match="no features"):
        workspace.train("machines", "x")


def test_date_typed_time(spark):
    """A date column works as time key: windows count days."""
    from tabwise.operators import features
    from tabwise.plans.specs import FeatureSpec

    df = spark.createDataFrame([("a", i) for i in range(10)], "e string, i int").withColumn(
        "d", F.expr("date_add(date'2024-01-01', i)")).withColumn("x", F.col("i").cast("double"))
    assert isinstance(df.schema["d"].dataType, T.DateType)
    spec = FeatureSpec.read("d", {"x": {"transforms": [{"mean": {"windows": ["3d"]}}]}})
    out, _ = features.build_features(df, DatasetSpec("d", "D", "e", "d"), spec)
    assert [r.x_mean_3d for r in out.orderBy("d").collect()][:4] == [0.0, 0.5, 1.0, 2.0]
