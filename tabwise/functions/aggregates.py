"""The named aggregations of slices and comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabwise.functions.scalars import as_column

_BY_NAME = {
    "mean": F.avg,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "std": F.stddev_samp,
    "median": F.median,
}
NAMES = tuple(_BY_NAME)


def check(name: str) -> str:
    if name not in _BY_NAME:
        raise ValueError(f"unsupported aggregation {name!r}; use one of {', '.join(NAMES)}")
    return name


def aggregate(name: str, column: str | Column) -> Column:
    return _BY_NAME[check(name)](as_column(column))
