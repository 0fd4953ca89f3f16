"""Attribution of predictions to features: exact for linear models, tree-path Shapley values for trees.

Output is long: (request columns, feature, value, impact). For every row, base value plus the sum of its
impacts is the model's raw output.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations
from math import factorial
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise.functions import scalars
from tabwise.operators import encoding
from tabwise.operators.models import SCALED, TrainedModel
from tabwise.session import checkpoint_dir

# Fixed value: shown when no category of a one-hot source is active.
UNSEEN = "(unseen)"
# Cells of one table of impacts; tables are broadcast, and their number depends on the model alone.
GRID_CELLS = 4096


def linear_impact(column: str, coefficient: float, mean: float) -> Column:
    """Effect of a value against the training mean, for a coefficient in the column's own unit."""
    return F.lit(float(coefficient)) * (scalars.named(column).cast("double") - F.lit(float(mean)))


def linear_attribution(
    df: DataFrame, keys: Sequence[str], coefficients: dict[str, float], means: dict[str, float]
) -> DataFrame:
    entries = F.array(*[
        F.struct(F.lit(c).alias("feature"), scalars.named(c).cast("double").alias("value"),
                 linear_impact(c, w, means[c]).alias("impact"))
        for c, w in coefficients.items()
    ])
    return df.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")


def tree_leaves(model: TrainedModel) -> list[tuple[float, list[tuple[int, float, list[tuple[float, bool]]]]]]:
    """Leaves of all trees: weighted value and, per feature on the path, its kept ratio and its tests.

    The nodes are read from the model's own saved form, in one job. Their number is set by the model (trees and depth), not
    by the data.
    """
    spark = SparkSession.active()
    place = f"{checkpoint_dir(spark)}/trees-{uuid4().hex}"
    model.estimator.write().save(place)
    nodes: dict[int, dict[int, Row]] = {}
    for row in spark.read.parquet(f"{place}/data").toLocalIterator():
        nodes.setdefault(row["treeID"], {})[row["nodeData"]["id"]] = row["nodeData"]
    out = []
    for tree, weight in enumerate(model.estimator.treeWeights):
        held, todo = nodes[tree], [(0, [])]
        while todo:
            number, path = todo.pop()
            node = held[number]
            if node["leftChild"] < 0:
                per_feature: dict[int, tuple[float, list]] = {}
                for feature, kept, threshold, left in path:
                    ratio, tests = per_feature.get(feature, (1.0, []))
                    per_feature[feature] = (ratio * kept, [*tests, (threshold, left)])
                out.append((weight * node["prediction"], [(f, r, t) for f, (r, t) in per_feature.items()]))
                continue
            split, rows = node["split"], node["rawCount"]
            for child, left in ((node["rightChild"], False), (node["leftChild"], True)):
                step = (split["featureIndex"], held[child]["rawCount"] / rows, split["leftCategoriesOrThreshold"][0], left)
                todo.append((child, [*path, step]))
    return out


def leaf_tables(leaves) -> list[tuple[np.ndarray, list, np.ndarray, float]]:
    """Per leaf: its features, their tests, the impacts for every pattern of passed tests, and its base value.

    A leaf is a product game: a feature in the coalition passes its own tests (0 or 1), a feature outside it
    passes with the ratio of training rows that did. The path holds at most depth features, so all patterns
    of passed tests fit a small table and a row only needs its pattern.
    """
    compiled = []
    for value, path in leaves:
        k = len(path)
        ratios = np.array([ratio for _, ratio, _ in path])
        patterns = (np.arange(2**k)[:, None] >> np.arange(k)) & 1
        table = np.zeros((2**k, k))
        for j in range(k):
            others = [i for i in range(k) if i != j]
            for size in range(k):
                weight = factorial(size) * factorial(k - size - 1) / factorial(k)
                for chosen in combinations(others, size):
                    rest = [i for i in others if i not in chosen]
                    table[:, j] += weight * patterns[:, list(chosen)].prod(axis=1) * ratios[rest].prod()
            table[:, j] *= value * (patterns[:, j] - ratios[j])
        features = np.array([f for f, _, _ in path], dtype=int)
        compiled.append((features, [tests for _, _, tests in path], table, value * float(ratios.prod())))
    return compiled


def grid_tables(leaves, cells: int = GRID_CELLS) -> tuple[list[tuple[np.ndarray, list[np.ndarray], np.ndarray]], float]:
    """Leaves grouped by feature set: (features, thresholds of each, impacts for every cell of their grid), and the base value.

    The thresholds that the leaves of a set test cut each feature into intervals, and inside a cell of intervals every leaf
    passes the same tests. Their impacts are added up per cell once, so a row costs one lookup per feature set, however many
    trees there are. A set whose grid would pass ``cells`` is cut into several.
    """
    compiled = leaf_tables(leaves)
    groups: dict[tuple, list] = {}
    for features, tests, table, _ in compiled:
        order = np.argsort(features)
        groups.setdefault(tuple(features[order]), []).append((order, tests, table))
    out = []
    for features, held in groups.items():
        if not features:
            continue
        lots, marks = [], [set() for _ in features]
        for leaf in sorted(held, key=lambda h: [sorted(h[1][j]) for j in h[0]]):
            more = [m | {t for t, _ in leaf[1][j]} for m, j in zip(marks, leaf[0])]
            if not lots or np.prod([len(m) + 1.0 for m in more]) > cells:
                lots.append([])
                more = [{t for t, _ in leaf[1][j]} for j in leaf[0]]
            lots[-1].append(leaf)
            marks = more
        for lot in lots:
            edges = [np.array(sorted({t for order, tests, _ in lot for t, _ in tests[order[k]]})) for k in range(len(features))]
            shape = [len(e) + 1 for e in edges]
            grid = np.zeros((int(np.prod(shape)), len(features)))
            for order, tests, table in lot:
                pattern = np.zeros(shape, dtype=int)
                for k, j in enumerate(order):
                    place = np.arange(shape[k])
                    at = np.searchsorted(edges[k], [t for t, _ in tests[j]])
                    passed = np.logical_and.reduce([place <= i if left else place > i for i, (_, left) in zip(at, tests[j])])
                    pattern |= passed.astype(int).reshape([-1 if d == k else 1 for d in range(len(shape))]) << int(j)
                grid += table[pattern.ravel()][:, order]
            out.append((np.array(features), edges, grid))
    return out, sum(base for _, _, _, base in compiled)


def shapley_batch(x: np.ndarray, tables, n_features: int) -> tuple[np.ndarray, float]:
    """Impacts of a batch of rows and the base value."""
    grids, base = tables
    impact = np.zeros((len(x), n_features))
    for features, edges, grid in grids:
        cell = np.zeros(len(x), dtype=int)
        for feature, marks in zip(features, edges):
            cell = cell * (len(marks) + 1) + np.searchsorted(marks, x[:, feature])  # thresholds below the value
        impact[:, features] += grid[cell]
    return impact, base


def tree_attribution(df: DataFrame, model: TrainedModel, keys: Sequence[str]) -> DataFrame:
    """Long table of impacts for feature rows, computed per Arrow batch with the tables of the leaves broadcast."""
    names = model.feature_names
    leaves = df.sparkSession.sparkContext.broadcast(grid_tables(tree_leaves(model)))
    filled = encoding.impute(df.select(*map(scalars.named, [*keys, *names])), model.medians)
    n = len(names)
    inputs = [f"x{i}" for i in range(n)]  # feature names may hold any character
    filled = filled.select(*map(scalars.named, keys), *[scalars.named(f).alias(x) for f, x in zip(names, inputs)])

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[inputs].to_numpy(dtype=float)
            impact, base = shapley_batch(x, leaves.value, n)
            rows = batch[list(keys)].loc[batch.index.repeat(n)].reset_index(drop=True)
            rows["feature"] = names * len(batch)
            rows["value"] = x.ravel()
            rows["impact"] = impact.ravel()
            rows["base_value"] = base
            yield rows

    fields = [filled.schema[k] for k in keys] + [
        T.StructField("feature", T.StringType()), T.StructField("value", T.DoubleType()),
        T.StructField("impact", T.DoubleType()), T.StructField("base_value", T.DoubleType()),
    ]
    return filled.mapInPandas(explain, T.StructType(fields))


def attribution(df: DataFrame, model: TrainedModel, keys: Sequence[str]) -> DataFrame:
    """Impacts by the method that fits the model; ``method`` names the one used."""
    if model.algorithm not in SCALED:
        return tree_attribution(df, model, keys).drop("base_value").withColumn("method", F.lit("tree_shapley"))
    names, sparse = model.fitted.expanded_names, model.fitted.sparse_features
    weights = {n: float(c) / model.scaling[n][1] for n, c in zip(names, model.estimator.coefficients)}
    means = {n: m for n, (m, _) in model.scaling.items()}
    filled = encoding.impute(df, model.medians)
    plain = {n: weights[n] for n in model.feature_names if n not in sparse}
    parts = [linear_attribution(filled, keys, plain, means)] if plain else []
    parts += [_sparse_attribution(filled, keys, index, held, weights, means) for index, held in sparse.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("method", F.lit("linear"))


def _sparse_attribution(df: DataFrame, keys: Sequence[str], index: str, names: list[str], weights, means) -> DataFrame:
    """One row for a column of many categories: its active one, with the impact of all of them.

    Without an active category the first one stands for the column, with the value 0.
    """
    average = sum(weights[n] * means[n] for n in names)
    rows = [(float(i), n, 1.0, weights[n] - average) for i, n in enumerate(names)] + [(float(len(names)), names[0], 0.0, -average)]
    table = df.sparkSession.createDataFrame(rows, "__index double, feature string, value double, impact double")
    return df.select(*map(scalars.named, keys), scalars.named(index).alias("__index")).join(table, "__index").drop("__index")


def group_onehot(contributions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Impacts per source column: one-hot columns summed with their active category, ``_current`` dropped."""
    source = scalars.onehot_source("feature")
    encoded = F.col("feature").contains("__")
    category = F.when(encoded, scalars.onehot_category("feature"))
    shaped = contributions.select(
        *keys, F.when(encoded, source).otherwise(scalars.strip_current("feature")).alias("feature"),
        encoded.alias("__encoded"), category.alias("__category"), "value", "impact",
    )
    detail = F.collect_list(F.when(F.col("__encoded"), F.struct(
        F.col("__category").alias("category"), F.col("value").alias("value"), F.col("impact").alias("impact")
    )))
    active = F.max(F.when(F.col("__encoded") & (F.col("value") == 1.0), F.col("__category")))
    grouped = shaped.groupBy(*keys, "feature", "__encoded").agg(
        F.sum("impact").alias("impact"), active.alias("__active"), F.max("value").alias("__value"),
        F.sort_array(detail).alias("categories"),
    )
    return grouped.select(
        *keys, "feature",
        F.when(F.col("__encoded"), F.coalesce("__active", F.lit(UNSEEN)))
        .otherwise(F.col("__value").cast("string")).alias("value"),
        "impact", "categories",
    )


def top_drivers(contributions: DataFrame, keys: Sequence[str], k: int = 10) -> DataFrame:
    """The k strongest positive, negative and absolute impacts of every request, as (ranking, position)."""
    rankings = {
        "positive": (F.col("impact") > 0, F.desc("impact")),
        "negative": (F.col("impact") < 0, F.asc("impact")),
        "absolute": (F.lit(True), F.desc(F.abs("impact"))),
    }
    columns = contributions.columns
    ranked = contributions
    for name, (_, order) in rankings.items():
        window = Window.partitionBy(*keys).orderBy(order, F.asc("feature"))
        ranked = ranked.withColumn(f"__{name}", F.row_number().over(window))
    held = F.array(*[
        F.struct(F.lit(n).alias("ranking"), F.col(f"__{n}").alias("position"),
                 (keep & (F.col(f"__{n}") <= k)).alias("keep"))
        for n, (keep, _) in rankings.items()
    ])
    listed = ranked.withColumn("__r", F.explode(F.filter(held, lambda e: e["keep"])))
    return listed.select(*columns, F.col("__r.ranking").alias("ranking"), F.col("__r.position").alias("position"))
