"""Registration of queries, and the small helpers they share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.functions.scalars import as_column

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    run: Query
    sql: str | None


REGISTRY: dict[str, Registered] = {}


# A mean of cents can sit exactly on a rounding tie, which engines resolve differently (and sums run in a
# different order in each). Both sides add the same tiny amount first, so no value sits on a tie.
def nudge(digits: int) -> float:
    return 10.0 ** -(digits + 3)


def steady_rounds(sql: str) -> str:
    """Turn every ``round(x, n)`` of a statement into ``round(x + nudge, n)``."""
    out, rest = "", sql
    while (start := rest.find("round(")) >= 0:
        depth, end, comma = 0, start + 6, -1
        while depth or rest[end] != ")":
            depth += {"(": 1, ")": -1}.get(rest[end], 0)
            comma = end if rest[end] == "," and depth == 0 else comma
            end += 1
        inner, digits = rest[start + 6:comma], int(rest[comma + 1:end])
        out += rest[:start] + f"round(({steady_rounds(inner)}) + {nudge(digits):.0e}, {digits})"
        rest = rest[end + 1:]
    return out + rest


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(run: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = Registered(run, steady_rounds(sql) if sql else None)
        return run

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def steady(column: str | Column, digits: int) -> Column:
    return F.round(as_column(column).cast("double") + F.lit(nudge(digits)), digits)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded for comparison across engines."""
    return df.select(*[
        steady(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes
    ])
