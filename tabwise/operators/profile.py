"""Profiling of declared columns, and the search contract built on it.

Each statistic group is one pass: scalars per column, value counts per (column, value), exact
quantiles. Columns travel as rows (column, value), so a pass shuffles on (column, value) and no column
is held by one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise.functions import quantiles
from tabwise.functions.scalars import micros, text_value
from tabwise.plans.specs import DatasetSpec, SearchSpec
from tabwise.session import settle

# Fixed value: categories listed per column.
TOP_VALUES = 10
# Values of one bitmap (fixed by Spark), and rows that a bitmap must stand for at least: its 4 KB then weigh no more than
# the rows that a shuffle of values would send.
BITMAP_VALUES, BITMAP_SHARE = 32_768, 256


def _declared(df: DataFrame, spec: DatasetSpec, *kinds: str) -> list[str]:
    return [c.name for c in spec.columns.values() if c.name in df.columns and (not kinds or c.type in kinds)]


def long_form(df: DataFrame, columns: Sequence[str], as_type: str) -> DataFrame:
    """(column, value) rows; one generator inside the scan stage."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast(as_type).alias("value")) for c in columns
    ]))
    return df.select(pairs.alias("p")).select("p.*")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n); null is a value."""
    return long_form(df, columns, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def column_counts(df: DataFrame, spec: DatasetSpec, columns: Sequence[str] | None = None) -> DataFrame:
    """Null and distinct counts per declared column; null counts as one distinct value."""
    names = list(columns or _declared(df, spec))
    dense = dense_integers(df, names)
    rest = [c for c in names if c not in dense]
    parts = [_bitmap_counts(df, list(dense))] if dense else []
    parts += [_column_counts(value_counts(df, rest))] if rest or not parts else []
    return reduce(DataFrame.unionByName, parts)


def dense_integers(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Whole-number columns whose range is short enough for bitmaps: one pass over minima and maxima."""
    whole = [c for c in columns if df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long")]
    if not whole:
        return []
    row = df.agg(F.count(F.lit(1)), *[f(c) for c in whole for f in (F.min, F.max)]).first()
    n, held = row[0], []
    for i, c in enumerate(whole):
        low, high = row[1 + 2 * i], row[2 + 2 * i]
        if low is not None and (high - low) // BITMAP_VALUES <= max(1, n // BITMAP_SHARE):
            held.append(c)
    return held


def _bitmap_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null and distinct counts by bitmaps: what is shuffled is one bitmap per bucket of values, not a row per value."""
    buckets = long_form(df, columns, "long").groupBy("column", F.bitmap_bucket_number("value").alias("bucket")).agg(
        F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("value"))).alias("held"),
        F.count_if(F.col("value").isNull()).alias("nulls"),
    )
    return buckets.groupBy("column").agg(
        F.sum("nulls").alias("null_count"),
        (F.sum(F.when(F.col("bucket").isNotNull(), F.col("held")).otherwise(0)) + F.max((F.col("nulls") > 0).cast("long"))).alias("unique_count"),
    )


def _column_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("column").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("null_count"),
        F.count(F.lit(1)).alias("unique_count"),
    )


def approx_column_counts(df: DataFrame, spec: DatasetSpec, columns: Sequence[str] | None = None) -> DataFrame:
    """Opt-in sketch: one pass and no shuffle of values, distinct counts within about 5 percent."""
    names = list(columns or _declared(df, spec))
    one = df.agg(*[
        F.struct(
            F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("null_count"),
            (F.approx_count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias("unique_count"),
        ).alias(f"s{i}") for i, c in enumerate(names)
    ])
    return one.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(names))])).alias("s")).select("s.*")


def numeric_stats(df: DataFrame, spec: DatasetSpec, columns: Sequence[str] | None = None) -> DataFrame:
    """min, max, mean, std, median (interpolated), p25 and p75 (nearest rank) per numeric column."""
    names = list(columns or _declared(df, spec, "numeric"))
    long = long_form(df, names, "double")
    moments = long.groupBy("column").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
    )
    bound = df.count(), len(names)
    spread = quantiles.group_quantiles(
        long, ["column"], "value", {"median": 0.5, "p25": 0.25, "p75": 0.75}, nearest=("p25", "p75"), sizes=bound
    )
    return moments.join(spread, "column", "left")


def top_values(df: DataFrame, spec: DatasetSpec, columns: Sequence[str] | None = None, k: int = TOP_VALUES):
    """Most frequent values per categorical column; ties by value. The row-number limit is applied map-side."""
    return _top(value_counts(df, list(columns or _declared(df, spec, "categorical"))), k)


def _top(counts: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_first("value"))
    return counts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def distribution(df: DataFrame, spec: DatasetSpec, columns: Sequence[str] | None = None) -> DataFrame:
    """Counts per value of boolean and event columns; null is a bucket named ``None``."""
    names = list(columns or dict.fromkeys([*_declared(df, spec, "boolean"), *[
        c for c in spec.with_role("event") if c in df.columns
    ]]))
    counts = value_counts(df, names)
    return counts.withColumn("value", F.coalesce("value", F.lit("None")))


def overview(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """One row: rows, columns, time range, entities."""
    entities = df.groupBy(spec.entity_key).agg(
        F.count(F.lit(1)).alias("__n"),
        *([F.min(spec.time_key).alias("__lo"), F.max(spec.time_key).alias("__hi")] if spec.time_key else []),
    )
    times = [F.min("__lo").cast("string").alias("time_start"), F.max("__hi").cast("string").alias("time_end")]
    return entities.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.count(F.lit(1)).alias("entity_count"),
        *(times if spec.time_key else []),
    )


def profile(df: DataFrame, spec: DatasetSpec, approximate: bool = False) -> DataFrame:
    """One row per declared column: type, role, counts, numeric statistics, top values.

    ``approximate`` sketches the distinct counts, so only categorical values are shuffled.
    """
    declared = df.sparkSession.createDataFrame(
        [(c.name, c.type, c.role) for c in spec.columns.values() if c.name in df.columns],
        "column string, type string, role string",
    )
    categorical = _declared(df, spec, "categorical")
    declared_columns = _declared(df, spec)
    dense = [] if approximate else [c for c in dense_integers(df, declared_columns) if c not in categorical]
    names = categorical if approximate else [c for c in declared_columns if c not in dense]
    # Distinct values with counts, written once: both the column counts and the top values read them.
    counts = settle(value_counts(df, names)) if names else None
    if approximate:
        columns = approx_column_counts(df, spec)
    else:
        parts = [_column_counts(counts)] if names else []
        parts += [_bitmap_counts(df, dense)] if dense else []
        columns = reduce(DataFrame.unionByName, parts)
    result = declared.join(columns, "column", "left")
    if _declared(df, spec, "numeric"):
        result = result.join(numeric_stats(df, spec), "column", "left")
    if categorical:
        ranked = _top(counts.where(F.col("column").isin(categorical)), TOP_VALUES).groupBy("column").agg(
            F.sort_array(F.collect_list(F.struct("position", "value", "n"))).alias("top_values")
        )
        result = result.join(ranked, "column", "left")
    return result


CONTRACT = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("field", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("operators", T.ArrayType(T.StringType())), T.StructField("unit", T.StringType()),
    T.StructField("aliases", T.ArrayType(T.StringType())), T.StructField("description", T.StringType()),
])


def search_contract(df: DataFrame, spec: DatasetSpec, search: SearchSpec | None) -> DataFrame:
    """Searchable fields with what the table holds now: category values or numeric range."""
    if search is None:
        raise ValueError(f"dataset {spec.dataset_id!r} has no search section")
    kinds = {n: c.type for n, c in spec.columns.items() if n in df.columns}
    entries = [
        (f.name, f.field, kinds.get(f.field), list(f.operators), f.unit, list(f.aliases), f.description)
        for f in search.fields.values()
    ]
    contract = df.sparkSession.createDataFrame(entries, CONTRACT)
    fields = list(dict.fromkeys(f.field for f in search.fields.values()))
    numeric = [c for c in fields if kinds.get(c) == "numeric"]
    categorical = [c for c in fields if kinds.get(c) == "categorical"]
    empty = df.sparkSession.createDataFrame([], "column string, min double, max double")
    ranges = long_form(df, numeric, "double").groupBy("column").agg(
        F.min("value").alias("min"), F.max("value").alias("max")
    ) if numeric else empty
    listed = top_values(df, spec, categorical).groupBy("column").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "value"))), lambda e: e["value"])
        .alias("categorical_values")
    ) if categorical else empty.select("column", F.lit(None).cast("array<string>").alias("categorical_values"))
    # The contract has one row per declared field.
    return (
        contract.join(F.broadcast(ranges.withColumnRenamed("column", "field")), "field", "left")
        .join(F.broadcast(listed.withColumnRenamed("column", "field")), "field", "left")
        .orderBy("name")
    )


def semantic_contract(df: DataFrame, search: SearchSpec) -> DataFrame:
    """Named semantic filters and what they expand to."""
    import json

    rows = [
        (s.name, s.type, s.min_field, s.max_field, json.dumps([dict(e) for e in s.expands_to]), s.unit, s.description)
        for s in search.semantics.values()
    ]
    return df.sparkSession.createDataFrame(
        rows, "name string, type string, min_field string, max_field string, expands_to string, unit string, "
        "description string",
    )


def time_span(df: DataFrame, time: str) -> DataFrame:
    """Earliest and latest time: the default as-of point is the latest."""
    return df.agg(F.min(time).alias("earliest"), F.max(time).alias("latest"), F.max(micros(time)).alias("latest_us"))
