"""Slices, multi-metric aggregation and comparison with the overall value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwise.functions import quantiles
from tabwise.functions.aggregates import aggregate, check
from tabwise.operators import filters as flt


def _grouped(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, str]], rows: bool) -> DataFrame:
    """Group once; medians of big groups come from the exact bracketed quantile."""
    keys = list(keys)
    medians = {out: col for out, (col, name) in wanted.items() if check(name) == "median"}
    direct = [aggregate(name, col).alias(out) for out, (col, name) in wanted.items() if out not in medians]
    counted = [F.count(F.lit(1)).cast("long").alias("row_count")] if rows else []
    sizes = quantiles.group_sizes(df.select(*keys), keys) if medians else (0, 0)
    if medians and sizes[0] <= quantiles.BUFFER_ROWS:
        direct += [F.median(col).alias(out) for out, col in medians.items()]
        medians = {}
    if not direct and not counted:
        counted = [F.count(F.lit(1)).alias("__rows")]
    result = df.groupBy(*keys).agg(*direct, *counted)
    for out, col in medians.items():
        part = quantiles.group_quantiles(df, keys, col, {out: 0.5}, sizes=sizes)
        part = part.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], out)
        on = reduce(
            lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.lit(True)
        )
        result = result.join(part, on, "left")
    return result.select(*keys, *wanted, *(["row_count"] if rows else []))


def slice_by(
    df: DataFrame, dimensions: Sequence[str], metric: str, aggregation: str = "mean",
    filters=None, order_by: str | None = None, limit: int = 0,
) -> DataFrame:
    """One metric by any number of dimensions, plus the row count; ``limit=0`` keeps all."""
    out = f"{metric}_{check(aggregation)}"
    result = _grouped(flt.matching(df, filters), dimensions, {out: (metric, aggregation)}, rows=True)
    if order_by:
        flt.check_columns(result, [order_by], "order column")
        result = result.orderBy(F.desc_nulls_first(order_by), *[F.asc_nulls_first(d) for d in dimensions])
    return result.limit(limit) if limit > 0 else result


def aggregate_by(
    df: DataFrame, group_by: Sequence[str], aggregations: Mapping[str, str], filters=None
) -> DataFrame:
    """Several metrics with one aggregation each, named ``{column}_{aggregation}``."""
    wanted = {f"{col}_{check(name)}": (col, name) for col, name in aggregations.items()}
    return _grouped(flt.matching(df, filters), group_by, wanted, rows=False)


def overall(df: DataFrame, metric: str, aggregation: str, out: str = "overall") -> DataFrame:
    """One row: the aggregation over the whole (filtered) table."""
    return _grouped(df, [], {out: (metric, aggregation)}, rows=False)


def compare(
    df: DataFrame, dimension: str, metric: str, aggregation: str = "mean", filters=None
) -> DataFrame:
    """Metric per value of one dimension against the same aggregation over all rows."""
    rows = flt.matching(df, filters)
    value = f"{metric}_{check(aggregation)}"
    groups = _grouped(rows, [dimension], {value: (metric, aggregation)}, rows=True)
    one_row = overall(rows, metric, aggregation, "overall")
    difference = F.col(value) - F.col("overall")
    return (
        groups.crossJoin(F.broadcast(one_row))
        .withColumn("relative_diff", difference / (F.abs("overall") + F.lit(1e-12)))
        .orderBy(F.desc_nulls_first(value), F.asc_nulls_first(dimension))
    )
