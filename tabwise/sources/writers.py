"""Sinks: full table, split table, CSV, metadata rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.operators.splits import NAMES


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_partitions(df: DataFrame, path: str, split: str = "split") -> dict[str, str | None]:
    """One directory per split; a split without rows has no directory and path None."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)
    found = {r[0] for r in df.sparkSession.read.parquet(path).select(split).distinct().collect()}
    return {name: f"{path}/{split}={name}" if name in found else None for name in NAMES}


def read_split(spark: SparkSession, path: str, name: str, split: str = "split") -> DataFrame:
    """One split; only its directory is read."""
    return spark.read.parquet(path).where(F.col(split) == name)


def append_metadata(spark: SparkSession, row: dict, path: str, schema: str) -> DataFrame:
    """Append one row to a metadata table; files are written whole, so readers see complete rows."""
    one = spark.createDataFrame([row], schema)
    one.write.mode("append").parquet(path)
    return one
