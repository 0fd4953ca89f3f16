"""Automatic discovery of slices whose metric deviates from the overall value.

The table is reduced once to one row of mergeable moments per combination of all dimensions (map-side combined, so a
value holding a third of the rows costs nothing), which is written. Slices are rolled up from it as an iceberg cube, one
number of dimensions after the other: a slice below ``min_sample_size`` has no refinement that reaches it, so a cell goes
only to the combinations all of whose parts are large enough. The table is read again for the ``top_k`` winners only,
because their exact median is the one statistic that cannot be merged. With the median as the metric itself, cells
count (dimensions, value), and medians are selected by weight for the slices that the cube has kept.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise.functions import quantiles
from tabwise.functions.aggregates import check
from tabwise.operators import filters as flt
from tabwise.plans.specs import DatasetSpec
from tabwise.session import settle

log = logging.getLogger(__name__)

# Expanded rows up to which all levels are rolled up together: leaving out small slices would cost more than it saves.
TOGETHER_ROWS = 5_000_000
# Winning slices whose conditions one scan evaluates.
SLICES_PER_PASS = 64


def dimension_sets(dimensions: Sequence[str], max_dimensions: int) -> list[tuple[str, ...]]:
    widest = min(max_dimensions, len(dimensions))
    return [combo for size in range(1, widest + 1) for combo in combinations(dimensions, size)]


def _moments(df: DataFrame, keys: list[str], metric: str) -> DataFrame:
    x = F.col(metric).cast("double")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("long").alias("__rows"), F.count(x).alias("__n"), F.sum(x).alias("__total"),
        F.var_pop(x).alias("__var"), F.min(x).alias("__low"), F.max(x).alias("__high"),
    )


def _merged(name: str, center: Column) -> Column:
    """The aggregation from cell moments; spread is taken around ``center`` to keep its digits."""
    n, total = F.sum("__n"), F.sum("__total")
    match name:
        case "mean":
            return total / F.when(n > 0, n)
        case "sum":
            return F.coalesce(total, F.lit(0.0))
        case "count":
            return n.cast("double")
        case "min":
            return F.min("__low")
        case "max":
            return F.max("__high")
    return _spread(center)


def _spread(center: Column) -> Column:
    n, total = F.sum("__n"), F.sum("__total")
    offset = F.col("__total") / F.when(F.col("__n") > 0, F.col("__n")) - center
    squares = F.sum(F.col("__n") * (F.col("__var") + offset * offset))
    shift = total / F.when(n > 0, n) - F.max(center)
    return F.when(n > 1, F.sqrt(F.greatest(squares - n * shift * shift, F.lit(0.0)) / (n - 1)))


def _set_id(dims: list[str], grouped: Sequence[str]) -> int:
    """Bit mask of the dimensions that are not grouped, the first one highest."""
    return sum(_bit(dims, d) for d in dims if d not in grouped)


def _same(a: str, b: str, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`")) for k in keys])


def iceberg(cells: DataFrame, dims: list[str], sets: list[tuple[str, ...]], least: int, *aggs: Column) -> DataFrame:
    """Slices (set_id, dimensions) of ``cells`` with at least ``least`` rows (``__rows``), and ``aggs`` of their cells.

    A dimension outside its set is null. Before a level, each cell knows which of its slices one level up are large enough.
    """
    keys, levels, parts = ["set_id", *dims], sorted({len(s) for s in sets}), []
    together = cells.count() * len(sets) <= TOGETHER_ROWS
    numbered, alive = cells, None
    if not together:
        numbered = settle(cells.withColumn("__cell", F.monotonically_increasing_id()))
    for level in levels[-1:] if together else levels:
        mine = sets if together else [s for s in sets if len(s) == level]
        choices = []
        for s in mine:
            entry = F.lit(_set_id(dims, s)).cast("long")
            if alive is not None:
                above = [F.lit(_set_id(dims, part)).cast("long") for part in combinations(s, level - 1)]
                entry = F.when(reduce(lambda a, b: a & b, [F.array_contains("__alive", p) for p in above]), entry)
            choices.append(entry)
        held = numbered if alive is None else numbered.join(alive, "__cell")
        expanded = held.withColumn("set_id", F.explode(F.array_compact(F.array(*choices))))
        for d in dims:
            expanded = expanded.withColumn(d, F.when(_grouped_in(F.col("set_id"), dims, d), F.col(d)))
        slices = expanded.groupBy(*keys).agg(F.sum("__rows").alias("row_count"), *aggs).where(F.col("row_count") >= least)
        if together:
            return slices
        slices = settle(slices)
        parts.append(slices)
        log.info("slices of %d dimensions with %d rows or more: %d", level, least, slices.count())
        if level < levels[-1]:
            pairs = expanded.select("__cell", *keys).alias("c").join(slices.select(*keys).alias("s"), _same("c", "s", keys), "left_semi")
            alive = settle(pairs.groupBy("__cell").agg(F.collect_list("set_id").alias("__alive")))  # sets of one level
    return reduce(DataFrame.unionByName, parts)


def interesting_slices(
    df: DataFrame,
    metric: str,
    dimensions: Sequence[str] | None = None,
    min_sample_size: int = 100,
    max_dimensions: int = 3,
    aggregation: str = "mean",
    filters=None,
    top_k: int = 20,
    spec: DatasetSpec | None = None,
) -> DataFrame:
    """Top slices over every combination of up to ``max_dimensions`` dimensions.

    Columns: dimensions array, values map, n_dimensions, row_count, metric_value, metric_median,
    metric_std, overall_baseline, difference, abs_difference. Dimensions default to the declared
    categorical features, without a spec to all string columns. A null value is a value.
    """
    check(aggregation)
    rows = flt.matching(df, filters)
    if dimensions is None:
        dimensions = spec.dimensions() if spec else [n for n, t in df.dtypes if t == "string" and n != metric]
    dims = [d for d in dimensions if d in df.columns]
    if not dims:
        raise ValueError("no dimensions to combine")
    rows = rows.select(*dims, F.col(metric).cast("double").alias("__metric"))
    sets = dimension_sets(dims, max_dimensions)

    if aggregation == "median":
        found = _median_slices(rows, dims, sets, min_sample_size)
    else:
        cells = settle(_moments(rows, dims, "__metric"))
        center, = cells.agg(F.sum("__total") / F.sum("__n")).first()
        around = F.lit(center).cast("double")
        whole = cells.agg(_merged(aggregation, around).alias("overall_baseline"))
        found = iceberg(cells, dims, sets, min_sample_size, _merged(aggregation, around).alias("metric_value"))
        found = found.crossJoin(F.broadcast(whole))  # one row
    # NaN can only come from NaN inputs; null slices cannot be ranked and are left out.
    ranked = (
        found.where((F.col("row_count") >= min_sample_size) & F.col("metric_value").isNotNull())
        .withColumn("difference", F.col("metric_value") - F.col("overall_baseline"))
        .withColumn("abs_difference", F.abs("difference"))
        .where(F.col("abs_difference").isNotNull())
        .withColumn("n_dimensions", F.lit(len(dims)) - F.bit_count("set_id"))
        .orderBy(
            F.desc("abs_difference"), F.asc("n_dimensions"), F.desc("set_id"),
            *[F.asc_nulls_first(d) for d in dims],
        )
        .limit(top_k)
    )
    return _describe(ranked, rows, dims)


def _bit(dims: list[str], name: str) -> int:
    return 1 << (len(dims) - 1 - dims.index(name))


def _grouped_in(set_id: Column, dims: list[str], name: str) -> Column:
    return set_id.bitwiseAND(F.lit(_bit(dims, name))) == 0


def _median_slices(rows: DataFrame, dims: list[str], sets: list[tuple[str, ...]], least: int) -> DataFrame:
    """Exact medians of the slices that the cube keeps, by weighted selection over (dimensions, value) counts."""
    counted = settle(rows.groupBy(*dims, "__metric").agg(F.count(F.lit(1)).alias("__rows")))
    cells = settle(counted.groupBy(*dims).agg(F.sum("__rows").alias("__rows")))
    kept = settle(iceberg(cells, dims, sets, least))
    keys = ["set_id", *dims]
    ids = [F.lit(_set_id(dims, s)).cast("long") for s in sets]
    expanded = counted.withColumn("set_id", F.explode(F.array(*ids)))
    for d in dims:
        expanded = expanded.withColumn(d, F.when(_grouped_in(F.col("set_id"), dims, d), F.col(d)))
    inside = expanded.alias("c").join(kept.select(*keys).alias("s"), _same("c", "s", keys), "left_semi").where(
        F.col("__metric").isNotNull())
    largest, groups = kept.agg(F.max("row_count"), F.count(F.lit(1))).first()
    if (largest or 0) <= quantiles.BUFFER_ROWS:
        medians = inside.groupBy(*keys).agg(F.percentile("__metric", 0.5, F.col("__rows")).alias("metric_value"))
    else:
        repeated = inside.select(*keys, "__metric", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__rows"))).alias("__one"))
        medians = quantiles.group_quantiles(
            repeated.drop("__one"), keys, "__metric", {"metric_value": 0.5}, sizes=(largest, groups))
    joined = kept.alias("c").join(medians.alias("m"), _same("c", "m", keys), "left").select("c.*", "m.metric_value")
    whole = quantiles.group_quantiles(rows, [], "__metric", {"overall_baseline": 0.5})
    return joined.crossJoin(F.broadcast(whole))


def _members(rows: DataFrame, batch: list[tuple], schema: T.StructType, dims: list[str]) -> DataFrame:
    """(slice_id, metric) for every slice a row belongs to, as literal conditions inside the scan: no join."""
    at = {name: i for i, name in enumerate(schema.names)}
    inside = []
    for winner in batch:
        grouped = [d for d in dims if not winner[at["set_id"]] & _bit(dims, d)]
        held = reduce(lambda a, b: a & b, [F.col(d).eqNullSafe(F.lit(winner[at[d]])) for d in grouped])
        inside.append(F.when(held, F.lit(winner[at["slice_id"]])))
    ids = F.array_compact(F.array(*inside)) if inside else F.array().cast("array<int>")
    return rows.select(F.explode(ids).alias("slice_id"), "__metric")


def _describe(ranked: DataFrame, rows: DataFrame, dims: list[str]) -> DataFrame:
    """Median and spread of the winning slices, then the readable dimension and value columns."""
    winners = ranked.collect()  # top_k rows
    numbered = [(i, *row) for i, row in enumerate(winners, start=1)]
    schema = T.StructType([T.StructField("slice_id", T.IntegerType()), *ranked.schema.fields])
    slices = rows.sparkSession.createDataFrame(numbered, schema)
    batches = [numbered[i:i + SLICES_PER_PASS] for i in range(0, len(numbered), SLICES_PER_PASS)] or [[]]
    members = reduce(DataFrame.unionByName, [_members(rows, batch, schema, dims) for batch in batches])
    spread = F.stddev_samp("__metric").alias("metric_std")
    largest = max((row.row_count for row in winners), default=0)
    if largest <= quantiles.BUFFER_ROWS:
        stats = members.groupBy("slice_id").agg(F.median("__metric").alias("metric_median"), spread)
    else:
        stats = members.groupBy("slice_id").agg(spread).join(
            quantiles.group_quantiles(members, ["slice_id"], "__metric", {"metric_median": 0.5}, sizes=(largest, len(winners))),
            "slice_id",
        )
    entry = lambda d: F.when(
        _grouped_in(F.col("set_id"), dims, d), F.struct(F.lit(d).alias("k"), F.col(d).cast("string").alias("v"))
    )
    entries = F.array_compact(F.array(*[entry(d) for d in dims]))
    return (
        slices.join(stats, "slice_id")
        .select(
            "slice_id", F.transform(entries, lambda e: e["k"]).alias("dimensions"),
            F.map_from_entries(entries).alias("values"), "n_dimensions", "row_count",
            "metric_value", "metric_median", "metric_std", "overall_baseline", "difference", "abs_difference",
        )
        .orderBy("slice_id")
    )
