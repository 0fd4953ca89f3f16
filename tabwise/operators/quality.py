"""Validation of a table against its declared columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise.plans.specs import PHYSICAL_TYPES, DatasetSpec

REPORT = T.StructType([
    T.StructField("check", T.StringType()), T.StructField("column", T.StringType()),
    T.StructField("severity", T.StringType()), T.StructField("n_violations", T.LongType()),
    T.StructField("message", T.StringType()),
])
TIME_TYPES = PHYSICAL_TYPES["timestamp"]


@dataclass(frozen=True)
class Finding:
    check: str
    column: str
    severity: str
    n_violations: int
    message: str


def schema_findings(schema: T.StructType, spec: DatasetSpec) -> list[Finding]:
    """Checks that need no scan: presence, physical types, time type."""
    present = {f.name: f.dataType for f in schema.fields}
    absent = [c for c in spec.required_columns() if c not in present]
    if absent:
        return [Finding("required_column", c, "error", 1, f"required column {c!r} is missing") for c in absent]
    found = [
        Finding("column_type", c.name, "error", 1,
                f"column {c.name!r} is {present[c.name].simpleString()}, declared {c.type}")
        for c in spec.columns.values() if not c.accepts(present[c.name])
    ]
    time = present.get(spec.time_key) if spec.time_key else None
    if time is not None and not isinstance(time, TIME_TYPES):
        found.append(Finding("time_type", spec.time_key, "warning", 1,
                             f"time key {spec.time_key!r} is {time.simpleString()}"))
    return found


def null_keys(df: DataFrame, entity: str) -> DataFrame:
    return df.agg(F.count_if(F.col(entity).isNull()).alias("n_violations"))


def duplicate_keys(df: DataFrame, entity: str, time: str) -> DataFrame:
    """Number of (entity, time) pairs that occur more than once."""
    pairs = df.groupBy(entity, time).agg(F.count(F.lit(1)).alias("__n"))
    return pairs.agg(F.count_if(F.col("__n") > 1).alias("n_violations"))


def row_checks(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Data checks as rows (check, column, severity, n_violations, message), violations only."""
    def shaped(counts: DataFrame, check: str, column: str, severity: str, text: str) -> DataFrame:
        n = F.col("n_violations")
        return counts.where(n > 0).select(
            F.lit(check).alias("check"), F.lit(column).alias("column"), F.lit(severity).alias("severity"),
            n.cast("long").alias("n_violations"), F.concat(n.cast("string"), F.lit(text)).alias("message"),
        )

    report = shaped(null_keys(df, spec.entity_key), "entity_null", spec.entity_key, "error",
                    " rows without an entity key")
    if spec.time_key:
        report = report.unionByName(shaped(
            duplicate_keys(df, spec.entity_key, spec.time_key), "duplicate_keys", spec.entity_key, "warning",
            " duplicated (entity, time) pairs",
        ))
    return report


def validate(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """All findings as a report DataFrame; missing columns end the checks."""
    found = schema_findings(df.schema, spec)
    rows = [(f.check, f.column, f.severity, f.n_violations, f.message) for f in found]
    report = df.sparkSession.createDataFrame(rows, REPORT)
    have = set(df.columns)
    if any(f.check == "required_column" for f in found) or not set(spec.keys) <= have:
        return report
    return report.unionByName(row_checks(df, spec))


def raise_on_errors(report: DataFrame) -> list[str]:
    """Fail with every error in one message; returns the warnings. One report row per check."""
    found = report.collect()
    errors = [r.message for r in found if r.severity == "error"]
    if errors:
        raise ValueError("validation failed: " + "; ".join(errors))
    return [r.message for r in found]
