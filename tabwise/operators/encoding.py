"""One-hot encoding, median imputation, standard scaling: fit small state, apply as Columns."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwise.functions import quantiles, scalars

# Categories of a column: beyond this the caller has to say so.
MAX_CATEGORIES = 10_000
# Categories above which linear models take a column as one sparse vector instead of one column per category.
SPARSE_FROM = 256


def category_counts(df: DataFrame, column: str, min_frequency: int = 1) -> DataFrame:
    """Categories with counts, most frequent first; null is not a category."""
    value = scalars.text_value(column).alias("category")
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(value)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_frequency)
        .orderBy(F.desc("n"), F.asc("category"))
    )


def fit_categories(
    df: DataFrame, min_frequency: Mapping[str, int], max_categories: int | None = MAX_CATEGORIES
) -> dict[str, list[str]]:
    """Ordered categories of several columns from one pass."""
    columns = list(min_frequency)
    if not columns:
        return {}
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), scalars.text_value(c).alias("category")) for c in columns
    ]))
    counts = df.select(pairs.alias("p")).select("p.*").where(F.col("category").isNotNull()).groupBy(
        "column", "category"
    ).agg(F.count(F.lit(1)).alias("n"))
    floor = F.create_map(*[F.lit(x) for c in columns for x in (c, int(min_frequency[c]))])
    counts = counts.where(F.col("n") >= floor[F.col("column")])
    room = None if max_categories is None else max_categories * len(columns) + 1
    found = (counts if room is None else counts.limit(room)).collect()
    result: dict[str, list[str]] = {c: [] for c in columns}
    for row in sorted(found, key=lambda r: (-r.n, r.category)):
        result[row.column].append(row.category)
    wide = [c for c, values in result.items() if max_categories is not None and len(values) > max_categories]
    if wide or (room is not None and len(found) >= room):
        raise ValueError(
            f"more than {max_categories} categories in {wide or columns}; raise max_categories or min_frequency"
        )
    return result


def onehot(column: str, categories: Sequence[str]) -> list[tuple[str, Column]]:
    """One tinyint per known category; unknown and null values give zeros."""
    value = scalars.text_value(column)
    return [
        (scalars.onehot_name(column, c), F.coalesce((value == F.lit(c)).cast("tinyint"), F.lit(0).cast("tinyint")))
        for c in categories
    ]


def sparse_name(column: str) -> str:
    """Column that holds the index of a row's category; the number of categories stands for none of them."""
    return scalars.onehot_name(column, "*")


def with_category_index(df: DataFrame, column: str, categories: Sequence[str], out: str) -> DataFrame:
    """Index of the category by one hash lookup; unknown and null values give ``len(categories)``."""
    text = f"__text_{out}"
    indexer = StringIndexerModel.from_labels(list(categories), inputCol=text, outputCol=out, handleInvalid="keep")
    return indexer.transform(df.withColumn(text, scalars.text_value(column))).drop(text)


def category_shares(df: DataFrame, index: str, size: int) -> list[float]:
    """Share of rows per category; one row per category comes back, at most ``max_categories``."""
    counts = {int(r[0]): r[1] for r in df.groupBy(scalars.named(index)).count().collect()}
    n = sum(counts.values()) or 1
    return [counts.get(i, 0) / n for i in range(size)]


def fit_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median per column; a column without values is imputed with 0."""
    columns = list(columns)
    if not columns:
        return {}
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), scalars.named(c).cast("double").alias("x")) for c in columns
    ]))
    rows = df.count()
    if rows * len(columns) <= quantiles.BUFFER_ROWS:  # all columns share one aggregation buffer
        fitted = df.agg(*[F.median(scalars.named(c).cast("double")).alias(c) for c in columns]).first().asDict()
    else:
        long = df.select(pairs.alias("p")).select("p.*")
        table = quantiles.group_quantiles(long, ["column"], "x", {"median": 0.5}, sizes=(rows, len(columns))).collect()
        fitted = {r["column"]: r["median"] for r in table}
    empty = [c for c in columns if fitted.get(c) is None]
    if empty:
        warnings.warn(f"columns without any value are imputed with 0: {empty}", stacklevel=2)
    return {c: 0.0 if fitted.get(c) is None else float(fitted[c]) for c in columns}


def impute(df: DataFrame, medians: Mapping[str, float]) -> DataFrame:
    fill = {c: F.coalesce(scalars.named(c).cast("double"), F.lit(v)) for c, v in medians.items() if c in df.columns}
    return df.withColumns(fill) if fill else df


def fit_scaling(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column; a constant column is divided by 1."""
    row = df.agg(*[
        f(scalars.named(c).cast("double")).alias(f"{k}{i}")
        for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))
    ]).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def scaled(column: str, fitted: tuple[float, float]) -> Column:
    mean, spread = fitted
    return (scalars.named(column).cast("double") - F.lit(mean)) / F.lit(spread)


def assemble(
    df: DataFrame, names: Sequence[str], out: str = "features", scaling: Mapping[str, Any] | None = None,
    sparse: Mapping[str, Sequence[str]] | None = None,
):
    """Feature vector in contract order, scaled first when constants are given.

    ``sparse`` names the columns that hold category indexes, with the names of their features. Those are divided by their
    deviation but not centred, which keeps them sparse; an intercept takes up the difference.
    """
    sparse = sparse or {}
    wide, inputs, helpers = df, [], []
    for i, name in enumerate(names):
        mine = f"__z{i}"
        if name not in sparse:
            wide = wide.withColumn(mine, scaled(name, scaling[name]) if scaling else scalars.named(name).cast("double"))
        else:
            index, encoded, size = f"__i{i}", f"__o{i}", len(sparse[name])
            known = {"ml_attr": {"type": "nominal", "name": index, "num_vals": size + 1}}
            wide = wide.withColumn(index, scalars.named(name).cast("double").alias(index, metadata=known))
            wide = OneHotEncoder(inputCol=index, outputCol=encoded, dropLast=True).fit(wide).transform(wide)
            factors = [1.0 / scaling[f][1] if scaling else 1.0 for f in sparse[name]]
            wide = ElementwiseProduct(scalingVec=Vectors.dense(factors), inputCol=encoded, outputCol=mine).transform(wide)
            helpers += [index, encoded]
        inputs.append(mine)
    # Names of single categories are not wanted as metadata of the vector.
    wide = wide.select(*map(scalars.named, df.columns), *[F.col(c).alias(c, metadata={}) for c in inputs])
    return VectorAssembler(inputCols=inputs, outputCol=out).transform(wide).drop(*inputs, *helpers)
