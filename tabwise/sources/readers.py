"""Sources: CSV with declared types, Parquet."""

from __future__ import annotations

from functools import reduce
from pathlib import PurePath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise.functions import scalars
from tabwise.plans.specs import DatasetSpec


def read_source(spark: SparkSession, path: str, spec: DatasetSpec | None = None) -> DataFrame:
    """Read by file suffix; CSV needs no inference pass because types come from the spec."""
    suffix = PurePath(path.rstrip("/")).suffix.lower()
    if suffix == ".csv":
        return coerce(spark.read.option("header", True).csv(path), spec) if spec else spark.read.option(
            "header", True
        ).csv(path)
    if suffix == ".parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported source format {suffix!r}; use .csv or .parquet")


def _coerced(name: str, declared: str, physical: T.DataType) -> Column | None:
    column = F.col(name)
    text = isinstance(physical, T.StringType)
    if declared == "timestamp" and text:
        return scalars.lenient_timestamp(column)
    if declared == "numeric" and text:
        return scalars.lenient(column, "double")
    if declared == "boolean" and (text or isinstance(physical, T.LongType)):
        number = scalars.lenient(column, "tinyint")
        if not text:
            return number
        spelled = F.lower(F.trim(column))
        return F.coalesce(number, F.when(spelled == "true", 1).when(spelled == "false", 0).cast("tinyint"))
    return None


def coerce(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Bring text columns to their declared type; a value that does not parse becomes null."""
    physical = {f.name: f.dataType for f in df.schema.fields}
    changed = {
        c.name: new for c in spec.columns.values() if c.name in physical
        and (new := _coerced(c.name, c.type, physical[c.name])) is not None
    }
    return df.withColumns(changed) if changed else df


def recent(df: DataFrame, time: str, as_of, history_micros: int | None) -> DataFrame:
    """Rows at or before a time and inside the history; both bounds reach the Parquet scan."""
    kind = df.schema[time].dataType
    bound = F.lit(as_of).cast("timestamp")
    rows = df.where(F.col(time) <= bound.cast(kind))
    if history_micros is None:
        return rows
    return rows.where(F.col(time) >= scalars.shift_time(bound, -history_micros).cast(kind))


def union_all(*frames: DataFrame) -> DataFrame:
    """Stack tables by column name; columns missing on one side are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
