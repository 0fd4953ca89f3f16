from itertools import permutations
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwise.operators import explain, features, models, scoring, splits
from tabwise.operators.filters import Filter
from tabwise.plans.specs import DatasetConfig
from tabwise.queries import REGISTRY

SMALL = "/root/testdata/sf0.001"
CONFIG = DatasetConfig.read({
    "dataset": {
        "dataset_id": "s", "entity_key": "machine_id", "time_key": "timestamp",
        "columns": {"machine_id": {"type": "categorical", "role": "identifier"}, "kind": {"type": "categorical"},
                    "timestamp": {"type": "timestamp"}, "value": {"type": "numeric"}},
        "split": {"train": 0.6, "validation": 0.2, "test": 0.2},
    },
    "features": {"value": {"transforms": ["current", {"mean": {"windows": ["3h"]}}, {"std": {"windows": ["6h"]}}]},
                 "kind": {"transforms": ["categorical"]}},
    "target": {"name": "y", "type": "classification", "source_column": "label", "positive_class": 1},
})
FLAT = DatasetConfig.read({
    "dataset": {"dataset_id": "f", "entity_key": "id", "columns": {
        "id": {"type": "string"}, "a": {"type": "numeric"}, "b": {"type": "numeric"}, "c": {"type": "categorical"}}},
    "features": {"a": {"transforms": ["current"]}, "b": {"transforms": ["current"]}, "c": {"transforms": ["categorical"]}},
    "target": {"name": "t", "type": "regression", "source_column": "y"},
})


@pytest.fixture(scope="module")
def labelled(sensors):
    hot = F.coalesce(F.col("value"), F.lit(50.0)) > 54
    odd = F.col("row_id") % 7 == 0
    return sensors.withColumn("label", (hot | ((F.col("kind") == "c") & odd)).cast("int")).cache()


@pytest.fixture(scope="module")
def flat(spark):
    rng = np.random.default_rng(9)
    n = 400
    frame = pd.DataFrame({"id": [f"e{i}" for i in range(n)], "a": rng.normal(5, 2, n), "b": rng.normal(0, 1, n),
                          "c": rng.choice(["u", "v"], n)})
    frame["y"] = 3 * frame["a"] - 2 * frame["b"] + (frame["c"] == "u") * 4 + rng.normal(0, .5, n)
    frame["z"] = (frame["y"] > frame["y"].median()).astype(int)
    return spark.createDataFrame(frame).cache()


@pytest.fixture(scope="module")
def logistic(labelled):
    return models.train_model(labelled, CONFIG, "m", "logistic_regression", ties=["row_id"])


@pytest.fixture(scope="module")
def trees(labelled):
    return models.train_model(labelled, CONFIG, "t", "xgboost", {"maxIter": 6, "maxDepth": 3}, ties=["row_id"])


def test_defaults_and_unknown_names():
    assert models.resolve_algorithm(None, True) == "boosted_regressor"
    assert models.resolve_algorithm("xgboost", False) == "boosted_classifier"
    for name, regression in (("nope", True), ("linear_regression", False), ("xgboost", True)):
        with pytest.raises(ValueError):
            models.resolve_algorithm(name, regression)


@pytest.mark.parametrize("name,kind,trees", [
    ("train_gbt_score", "boosted_classifier", 200), ("feature_importance", "boosted_classifier", 200),
    ("tree_attribution", "boosted_classifier", 200), ("train_gbt_regression", "boosted_regressor", 300)])
def test_registered_queries_fit_the_declared_trees(spark, monkeypatch, name, kind, trees):
    class Fitted(Exception):
        pass

    class Declared:
        def __init__(self, **params):
            self.params = params

        def fit(self, rows):
            raise Fitted(self.params["maxIter"])

    if not Path(SMALL).exists():
        pytest.skip("test tables are not here")
    monkeypatch.setattr(models, "GBTClassifier" if kind == "boosted_classifier" else "GBTRegressor", Declared)
    with pytest.raises(Fitted) as found:
        REGISTRY[name].run(spark, SMALL)
    assert found.value.args == (trees,)


def test_training_reports_and_learns(logistic, trees):
    for model in (logistic, trees):
        assert model.feature_names[:3] == ["value_current", "value_mean_3h", "value_std_6h"]
        assert model.metrics["test"]["roc_auc"] > 0.85 and 0 < model.threshold < 1
        assert sum(model.metrics["rows"].values()) == 720
        assert model.periods["train"][1] <= model.periods["test"][0]


def test_logistic_matches_newton(flat, spark):
    """Balanced class weights, L2 penalty 1 on standardised inputs, unpenalised intercept."""
    config = DatasetConfig.read({**__import__("json").loads(FLAT.raw), "target": {
        "name": "t", "type": "classification", "source_column": "z"}})
    model = models.train_model(flat.where("id < 'e3'"), config, "l", "logistic_regression", {"tol": 1e-12})
    rows = splits.random_split(flat.where("id < 'e3'"), "id", config.dataset.split, out="s").where("s = 'train'").toPandas()
    x = np.column_stack([rows["a"], rows["b"], *[(rows["c"] == c) for c in model.fitted.categories["c"]]]).astype(float)
    x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    x1, y = np.column_stack([np.ones(len(x)), x]), rows["z"].to_numpy()
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    penalty = np.diag([0.0] + [1.0] * x.shape[1])
    beta = np.zeros(x1.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x1 @ beta))
        beta -= np.linalg.solve((x1 * (w * p * (1 - p))[:, None]).T @ x1 + penalty, x1.T @ (w * (p - y)) + penalty @ beta)
    assert np.allclose(model.estimator.coefficients.toArray(), beta[1:], atol=1e-4)
    assert model.estimator.intercept == pytest.approx(beta[0], abs=1e-4)


def test_ridge_matches_closed_form(flat):
    model = models.train_model(flat, FLAT, "r", "linear_regression")
    rows = splits.random_split(flat, "id", FLAT.dataset.split, out="s").where("s = 'train'").toPandas()
    x = np.column_stack([rows["a"], rows["b"], *[(rows["c"] == c) for c in model.fitted.categories["c"]]]).astype(float)
    x = (x - x.mean(0)) / x.std(0)
    y = rows["y"].to_numpy()
    beta = np.linalg.solve(x.T @ x + np.eye(x.shape[1]), x.T @ (y - y.mean()))
    assert np.allclose(model.estimator.coefficients.toArray(), beta, atol=1e-6)
    assert model.metrics["test"]["r2"] > 0.95 and model.metrics["test"]["baseline_r2"] < 0.1


def test_save_and_load_give_the_same_scores(spark, tmp_path, labelled, logistic, trees):
    for model in (logistic, trees):
        again = models.TrainedModel.load(spark, model.save(spark, str(tmp_path / model.model_id)))
        before = scoring.score_as_of(model, labelled).orderBy("machine_id").collect()
        after = scoring.score_as_of(again, labelled).orderBy("machine_id").collect()
        assert [r.machine_id for r in before] == [r.machine_id for r in after]
        assert np.allclose([r.prediction for r in before], [r.prediction for r in after])
        assert again.threshold == model.threshold and again.feature_names == model.feature_names
        assert {r.feature for r in again.importance(spark).collect()} == set(model.feature_names)


def test_train_and_score_features_agree(labelled, logistic):
    """As-of features of the last row equal the features training would give that row."""
    from tabwise.operators import features, joins

    cut = "2024-01-02 03:00:00"
    asof = scoring.features_as_of(CONFIG, logistic.fitted, labelled, cut)
    whole, _ = features.build_features(labelled, CONFIG.dataset, CONFIG.features, logistic.fitted)
    want = joins.latest_per_entity(whole, "machine_id", "timestamp", cut)
    assert sorted(map(tuple, asof.collect())) == sorted(map(tuple, want.collect()))


def test_requests_carry_errors(spark, labelled, logistic):
    asked = spark.createDataFrame(
        [("m0", "2024-01-02 03:00:00"), ("m1", "2020-01-01 00:00:00"), ("nobody", "2024-01-02 00:00:00")],
        "machine_id string, as_of string").withColumn("as_of", F.to_timestamp("as_of"))
    rows = {r.machine_id: r for r in scoring.score_requests(logistic, labelled, asked).collect()}
    single = {r.machine_id: r for r in scoring.score_as_of(logistic, labelled, "2024-01-02 03:00:00").collect()}
    assert rows["m0"].prediction == pytest.approx(single["m0"].prediction) and rows["m0"].prediction_error is None
    for name in ("m1", "nobody"):
        assert rows[name].prediction is None and "no observation" in rows[name].prediction_error


def test_records_and_entities(spark, labelled, logistic, flat):
    model = models.train_model(flat, FLAT, "r", "linear_regression")
    records = spark.createDataFrame([(5.0, 0.0, "u"), (5.0, 0.0, "new"), (None, 0.0, "v")], "a double, b double, c string")
    assert scoring.score_records(model, records).where("prediction is not null").count() == 3
    some = flat.limit(5)
    assert scoring.score_entities(model, flat, some).count() == 5
    assert scoring.score_entities(logistic, labelled).count() == 6
    with pytest.raises(ValueError, match="look back"):
        scoring.score_records(logistic, labelled)
    with pytest.raises(ValueError, match="lack"):
        scoring.score_records(model, records.drop("a"))


def test_search_then_predict(spark, labelled, logistic):
    catalogue = spark.createDataFrame([(f"m{i}", i) for i in range(4)] + [("ghost", 9)], "machine_id string, size int")
    found = scoring.search_and_predict(catalogue, logistic, labelled, filters=[Filter("size", "gte", 1)])
    rows = found.rows.collect()
    values = [r.prediction for r in rows[:-1]]
    assert rows[-1].machine_id == "ghost" and rows[-1].prediction is None and rows[-1].prediction_error
    assert values == sorted(values, reverse=True) and len(rows) == 4
    assert all(r.prediction_label == ("risk" if r.prediction >= logistic.threshold else "safe") for r in rows[:-1])


def test_rank_before_limit_differs(spark):
    catalogue = spark.createDataFrame([(f"p{i}", i) for i in range(6)], "id string, size int")
    scores = catalogue.select("id", (F.col("size") / 10).alias("prediction"))
    first = scoring.rank_search(catalogue, scores, "id", limit=2).rows.collect()
    best = scoring.rank_search(catalogue, scores, "id", limit=2, rank_before_limit=True).rows.collect()
    assert [r.id for r in first] == ["p1", "p0"] and [r.id for r in best] == ["p5", "p4"]


def test_staged_scores(spark):
    a = spark.createDataFrame([("x", .1), ("y", .2)], "id string, prediction double")
    b = spark.createDataFrame([("x", .5)], "id string, prediction double")
    assert {(r.id, r.a, r.b) for r in scoring.staged_scores({"a": a, "b": b}, "id").collect()} == {("x", .1, .5), ("y", .2, None)}


def test_evaluation_on_held_out_rows(labelled, logistic):
    divided = splits.assign_split(labelled, "machine_id", "timestamp", (0.6, 0.3, 0.1), ties=["row_id"])
    result = scoring.evaluate(logistic, divided, filters={"kind": "a"}, sample_size=7)
    whole, part = result.overall.first(), result.filtered.first()
    held = divided.where("split = 'evaluation'")
    assert whole.tn + whole.fp + whole.fn + whole.tp == held.count()
    assert part.tn + part.fp + part.fn + part.tp == held.where("kind = 'a'").count()
    assert result.sample.count() == 7 and {"actual", "predicted"} <= set(result.sample.columns)
    cold = scoring.evaluate(logistic, divided, cold_start=True).overall.first()
    assert cold.tn + cold.fp + cold.fn + cold.tp == held.count()
    with pytest.raises(ValueError, match="no held-out rows"):
        scoring.evaluate(logistic, divided, filters={"kind": "zzz"})


def brute_shapley(leaves, row, n):
    """Average marginal contribution over all orders of the features, from the same leaf game."""
    def value(known):
        total = 0.0
        for leaf, path in leaves:
            weight = leaf
            for f, ratio, tests in path:
                passes = all((row[f] <= t) if left else (row[f] > t) for t, left in tests)
                weight *= float(passes) if f in known else ratio
            total += weight
        return total

    out = np.zeros(n)
    orders = list(permutations(range(n)))
    for order in orders:
        known = set()
        for f in order:
            before = value(known)
            known.add(f)
            out[f] += value(known) - before
    return out / len(orders), value(set())


def test_tree_attribution_is_exact_and_additive(spark, labelled, trees):
    leaves = explain.tree_leaves(trees)
    n = len(trees.feature_names)
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.normal(52, 12, (4, 3)), rng.integers(0, 2, (4, n - 3))])
    impact, base = explain.shapley_batch(x, explain.grid_tables(leaves), n)
    for row, got in zip(x, impact):
        want, empty = brute_shapley(leaves, row, n)
        assert np.allclose(got, want) and base == pytest.approx(empty)
    rows = scoring.features_as_of(CONFIG, trees.fitted, labelled)
    long = explain.tree_attribution(rows, trees, ["machine_id"])
    sums = {r.machine_id: r.base + r.total for r in long.groupBy("machine_id").agg(
        F.sum("impact").alias("total"), F.max("base_value").alias("base")).collect()}
    for r in trees.transform(rows).collect():
        margin = 0.5 * np.log(r.prediction / (1 - r.prediction))  # the raw output of boosted classification trees
        assert sums[r.machine_id] == pytest.approx(margin, abs=1e-6)


def test_linear_attribution_sums_to_the_margin(labelled, logistic):
    rows = scoring.features_as_of(CONFIG, logistic.fitted, labelled)
    long = explain.attribution(rows, logistic, ["machine_id"])
    assert long.select("method").distinct().first()[0] == "linear"
    sums = {r.machine_id: r.s for r in long.groupBy("machine_id").agg(F.sum("impact").alias("s")).collect()}
    for r in logistic.transform(rows).collect():
        margin = np.log(r.prediction / (1 - r.prediction)) - logistic.estimator.intercept
        assert sums[r.machine_id] == pytest.approx(margin, abs=1e-6)


def test_grouping_and_drivers(spark):
    rows = [("r", "product_id__PROD_A", 0.0, 0.0004), ("r", "product_id__PROD_B", 1.0, 0.0006),
            ("r", "exposure_dose_current", 24.9, -0.0010), ("r", "tool__x__y", 0.0, 0.5)]
    long = spark.createDataFrame(rows, "id string, feature string, value double, impact double")
    got = {r.feature: r for r in explain.group_onehot(long, ["id"]).collect()}
    assert got["product_id"].value == "PROD_B" and got["product_id"].impact == pytest.approx(0.0010)
    assert [c.category for c in got["product_id"].categories] == ["PROD_A", "PROD_B"]
    assert got["exposure_dose"].value == "24.9" and got["tool__x"].value == explain.UNSEEN
    top = explain.top_drivers(explain.group_onehot(long, ["id"]), ["id"], 1).collect()
    assert {(r.ranking, r.feature) for r in top} == {("positive", "tool__x"), ("negative", "exposure_dose"), ("absolute", "tool__x")}


def test_categories_with_dots_and_backticks(spark):
    rng = np.random.default_rng(4)
    kinds = ["v1.2", "a`b", "plain"]
    rows = [(f"e{i}", kinds[i % 3], float(i % 3) * 10 + float(rng.normal())) for i in range(240)]
    df = spark.createDataFrame(rows, "id string, kind string, y double")
    config = DatasetConfig.read({
        "dataset": {"dataset_id": "d", "entity_key": "id"},
        "features": {"kind": {"transforms": ["categorical"]}},
        "target": {"name": "t", "type": "regression", "source_column": "y"}})
    for algorithm, params in (("linear_regression", None), ("xgboost_regressor", {"maxIter": 2})):
        model = models.train_model(df, config, "dots", algorithm, params)
        assert {f"kind__{k}" for k in kinds} == set(model.feature_names)
        assert model.metrics["test"]["r2"] > 0.1
        assert scoring.score_entities(model, df).count() == 240
        from tabwise.operators import features

        built, _ = features.build_features(df, config.dataset, config.features, model.fitted)
        grouped = explain.group_onehot(explain.attribution(built, model, ["id"]), ["id"])
        assert {(r.feature, r.value) for r in grouped.collect()} == {("kind", k) for k in kinds}


def test_one_lookup_per_feature_set():
    """Leaves of many trees over few feature sets: grids, also cut ones, equal the leaves one by one."""
    rng = np.random.default_rng(7)
    leaves = []
    for _ in range(300):
        features = rng.choice(5, rng.integers(0, 4), replace=False)
        path = [(int(f), float(rng.uniform(0.1, 1)), [(float(rng.integers(0, 9)), bool(rng.integers(0, 2)))
                                                      for _ in range(rng.integers(1, 3))]) for f in features]
        leaves.append((float(rng.normal()), path))
    x = rng.integers(-1, 10, (40, 5)).astype(float) + rng.choice([0, 0.5], (40, 5))
    want, base = np.zeros((40, 5)), 0.0
    for features, tests, table, leaf_base in explain.leaf_tables(leaves):
        base += leaf_base
        for i, row in enumerate(x):
            passed = [all((row[f] <= t) == left for t, left in held) for f, held in zip(features, tests)]
            want[i, features] += table[sum(int(p) << j for j, p in enumerate(passed))]
    for cells in (explain.GRID_CELLS, 30):
        tables = explain.grid_tables(leaves, cells)
        got, total = explain.shapley_batch(x, tables, 5)
        assert np.allclose(got, want) and total == pytest.approx(base)
        assert cells == 30 or len(tables[0]) <= 25  # sets of up to three of five features


def test_requests_read_only_history_they_can_see(spark, labelled, logistic):
    asked = spark.createDataFrame(
        [("m0", "2024-01-02 03:00:00"), ("m0", "2024-01-01 08:00:00"), ("m1", "2024-01-02 03:00:00"), ("m2", "2020-01-01 00:00:00")],
        "machine_id string, as_of string").withColumn("as_of", F.to_timestamp("as_of"))
    part = scoring.asked_history(CONFIG, labelled, asked, "as_of").select("machine_id", "timestamp").collect()
    span = __import__("tabwise.plans.durations", fromlist=["micros"]).micros(CONFIG.features.max_history_window()) / 1e6
    times, want = {}, set()
    for r in labelled.collect():
        times.setdefault(r.machine_id, []).append(r.timestamp)
    for a in asked.collect():
        seen = [t for t in times.get(a.machine_id, []) if t <= a.as_of]
        if seen:
            want |= {(a.machine_id, t) for t in times[a.machine_id] if 0 <= (max(seen) - t).total_seconds() < span}
    assert {tuple(r) for r in part} == want and 0 < len(want) < labelled.count()
    every = {(r.machine_id, r.as_of): r.prediction for r in scoring.score_requests(logistic, labelled, asked).collect()}
    for (machine, as_of), got in every.items():
        alone = {r.machine_id: r.prediction for r in scoring.score_as_of(logistic, labelled, str(as_of)).collect()}
        assert got is None and machine == "m2" or got == pytest.approx(alone[machine], abs=1e-9)


def test_ridge_beyond_the_normal_equations(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 6))
    y = x @ np.arange(6) + rng.normal(size=80)
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], [models.VECTOR, models.LABEL])
    exact = models.fit_estimator(df, "linear_regression").coefficients.toArray()
    monkeypatch.setattr(models, "NORMAL_FEATURES", 5)
    assert np.allclose(models.fit_estimator(df, "linear_regression").coefficients.toArray(), exact, atol=1e-5)


WIDE = DatasetConfig.read({
    "dataset": {"dataset_id": "w", "entity_key": "id", "columns": {"city": {"type": "categorical"}, "size": {"type": "numeric"}}},
    "features": {"size": {"transforms": ["current"]}, "city": {"transforms": ["categorical"]}},
    "target": {"name": "y", "type": "binary", "source_column": "y", "positive_class": 1}})


@pytest.mark.parametrize("algorithm", ["logistic_regression", "linear_regression"])
def test_sparse_categories_equal_one_column_each(spark, monkeypatch, algorithm):
    """The same predictions, coefficients and impacts, whether a column's categories are one sparse vector or columns."""
    raw = {**__import__("json").loads(WIDE.raw)}
    if algorithm == "linear_regression":
        raw["target"] = {"name": "y", "type": "regression", "source_column": "y"}
    config = DatasetConfig.read(raw)
    rows = [(k, float(k % 11), None if k % 50 == 0 else f"c{k * k % 23}", int((k * 7) % 13 < 6 + (k * k % 23 > 11))) for k in range(600)]
    df = spark.createDataFrame(rows, "id int, size double, city string, y int")
    dense = models.train_model(df, config, "d", algorithm)
    monkeypatch.setattr(models.encoding, "SPARSE_FROM", 5)
    sparse = models.train_model(df, config, "s", algorithm)
    assert dense.fitted.sparse == [] and sparse.fitted.sparse == ["city"]
    assert sparse.fitted.expanded_names == dense.feature_names and len(sparse.feature_names) == 2
    a, b = ({r.feature: r.importance for r in m.importance(spark).collect()} for m in (dense, sparse))
    assert a == pytest.approx(b, abs=1e-5)
    new = spark.createDataFrame([(1, 3.0, "c4"), (2, 9.0, "nowhere"), (3, None, None)], "id int, size double, city string")
    got = [{r.id: r.prediction for r in scoring.score_records(m, new).collect()} for m in (dense, sparse)]
    assert got[0] == pytest.approx(got[1], abs=1e-6)
    built = [features.build_features(new, m.config.dataset, m.config.features, m.fitted)[0] for m in (dense, sparse)]
    summed = [{(r.id, r.feature): (r.value, r.impact) for r in explain.group_onehot(
        explain.attribution(x, m, ["id"]), ["id"]).collect()} for x, m in zip(built, (dense, sparse))]
    assert summed[0].keys() == summed[1].keys()
    for key, (value, impact) in summed[0].items():
        assert summed[1][key][0] == value and summed[1][key][1] == pytest.approx(impact, abs=1e-5)
    again = models.features.FittedFeatures.from_dict(sparse.fitted.to_dict())
    assert again == sparse.fitted


def test_fifty_thousand_categories_train(spark):
    df = spark.range(150_000).select(
        F.col("id").cast("int"), (F.col("id") % 7).cast("double").alias("size"), F.concat(F.lit("c"), F.col("id") % 50_000).alias("city"),
        ((F.col("id") % 50_000) % 2).cast("int").alias("y"))
    model = models.train_model(df, WIDE, "w", "logistic_regression", {"maxIter": 15}, max_categories=60_000)
    assert len(model.fitted.expanded_names) > 40_000 and model.metrics["test"]["roc_auc"] > 0.9
    ridge = DatasetConfig.read({**__import__("json").loads(WIDE.raw), "target": {"name": "y", "type": "regression", "source_column": "y"}})
    fitted = models.train_model(df, ridge, "r", "linear_regression", {"maxIter": 15}, max_categories=60_000)
    assert fitted.metrics["test"]["r2"] > 0.3
