"""The one-job trainer of boosted trees against Spark's own."""

import numpy as np
import pytest
from pyspark.ml import classification, regression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabwise.operators import boosting

NAMES = ["a", "b", "kind", "hour", "sparse", "same"]
PARAMS = {"featuresCol": "f", "labelCol": "y", "maxIter": 6, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8,
          "featureSubsetStrategy": "0.8", "minInstancesPerNode": 3, "seed": 42}
KINDS = {"classifier": (classification.GBTClassifier, boosting.GBTClassifier),
         "regressor": (regression.GBTRegressor, boosting.GBTRegressor)}


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.range(0, 12_000, 1, 3).selectExpr(
        "rand(1) a", "randn(2) b", "cast(id % 3 = 1 as double) kind", "cast(hash(id) % 24 as double) hour",
        "case when rand(3) < 0.4 then 0D else rand(4) end sparse", "2D same")
    rows = rows.withColumn("y", F.col("a") * 3 + F.col("b") + F.col("kind") + F.randn(5))
    rows = VectorAssembler(inputCols=NAMES, outputCol="f").transform(rows)
    return rows.select(F.col("f").alias("f", metadata={}), "y").persist()


def labelled(table, kind):
    return table if kind == "regressor" else table.withColumn("y", (F.col("y") > 1.9).cast("double"))


def nodes(spark, model, place):
    model.write().save(str(place))
    read = spark.read.parquet(f"{place}/data").select("treeID", "nodeData.*").orderBy("treeID", "id")
    return [tuple(r) for r in read.collect()]


@pytest.mark.parametrize("kind", KINDS)
def test_trees_are_those_of_spark(spark, table, tmp_path, kind):
    """Bit for bit: thresholds, samples, feature subsets, gains, leaves."""
    theirs, ours = KINDS[kind]
    rows = labelled(table, kind)
    want, got = theirs(**PARAMS).fit(rows), ours(**PARAMS).fit(rows)
    assert type(got) is type(want) and got.treeWeights == want.treeWeights
    assert nodes(spark, got, tmp_path / "got") == nodes(spark, want, tmp_path / "want")
    scores = [r[0] for r in got.transform(rows).select("prediction").limit(50).collect()]
    assert scores == [r[0] for r in want.transform(rows).select("prediction").limit(50).collect()]


@pytest.mark.parametrize("kind", KINDS)
def test_several_tasks_grow_the_same_trees(spark, table, tmp_path, monkeypatch, kind):
    _, ours = KINDS[kind]
    rows = labelled(table, kind)
    one = nodes(spark, ours(**PARAMS).fit(rows), tmp_path / "one")
    monkeypatch.setattr(boosting, "TASK_ROWS", 5000)
    two = nodes(spark, ours(**PARAMS).fit(rows), tmp_path / "two")
    assert [r[:2] + r[-3:] for r in one] == [r[:2] + r[-3:] for r in two]  # sums are added in another order
    assert np.allclose([r[2] for r in one], [r[2] for r in two])


def test_jobs_do_not_grow_with_the_trees(spark, table):
    context, counts = spark.sparkContext, []
    for trees in (2, 30):
        context.setJobGroup(f"trees-{trees}", "")
        boosting.GBTRegressor(**{**PARAMS, "maxIter": trees}).fit(table)
        counts.append(len(context.statusTracker().getJobIdsForGroup(f"trees-{trees}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1]


def test_constant_features_and_what_is_left_to_spark(spark):
    rows = VectorAssembler(inputCols=["x"], outputCol="f").transform(spark.range(40).selectExpr("1D x", "cast(id % 4 as double) y"))
    assert boosting.GBTRegressor(**PARAMS).fit(rows).transform(rows).first()["prediction"] == pytest.approx(
        regression.GBTRegressor(**PARAMS).fit(rows).transform(rows).first()["prediction"])
    assert boosting.fit_trees(boosting.GBTRegressor(**PARAMS, weightCol="y"), rows, None, False) is None
    with pytest.raises(Exception, match="(?i)label"):
        boosting.GBTClassifier(**PARAMS).fit(rows)


def test_every_boosted_model_is_trained_this_way():
    from tabwise.operators import models

    assert models.GBTClassifier is boosting.GBTClassifier and models.GBTRegressor is boosting.GBTRegressor
