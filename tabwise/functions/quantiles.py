"""Exact quantiles per group, without holding a group in one task.

The built-in exact ``percentile`` keeps every distinct value of a group in one aggregation
buffer, which is right for many small groups. For groups above ``buffer_rows`` the quantile
is first bracketed with the mergeable sketch behind ``percentile_approx`` (rank error at most
``n / accuracy``, so a bracket of twice that on each side holds the wanted rank once a group has a few
times ``accuracy`` rows; smaller groups are counted whole); only values inside the bracket are then counted exactly, so a group holding
a third of the table leaves a fraction of about ``4 / accuracy`` of its rows to sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUFFER_ROWS = 1_000_000
ACCURACY = 10_000
# Bracket rows (groups times fractions) up to which they are broadcast to the table instead of shuffling it.
BROADCAST_ROWS = 100_000


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(rows of the largest group, number of groups): one pass with map-side counts."""
    if not keys:
        return df.count(), 1
    largest, groups = df.groupBy(*keys).count().agg(F.max("count"), F.count(F.lit(1))).first()
    return largest or 0, groups


def _position(n: Column, q: float, nearest: bool) -> Column:
    exact = (n - 1) * F.lit(float(q))
    return F.floor(exact + 0.5).cast("double") if nearest else exact


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: Mapping[str, float],
    nearest: Sequence[str] = (),
    buffer_rows: int = BUFFER_ROWS,
    accuracy: int = ACCURACY,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """One row per group with a column per requested fraction.

    Fractions interpolate between neighbours; those named in ``nearest`` return the element at 0-based
    rank ``floor((n - 1) * q + 0.5)``. Nulls are ignored; a group of nulls gives nulls. ``sizes`` is the
    result of ``group_sizes``, or an upper bound of it, where the caller already knows it.
    """
    keys = list(keys)
    data = df.select(*keys, F.col(value).cast("double").alias("__v"))
    largest, groups = sizes or group_sizes(data, keys)
    small = largest <= buffer_rows
    if small and not nearest:
        return data.groupBy(*keys).agg(*[F.percentile("__v", q).alias(name) for name, q in fractions.items()])
    if small:
        return _by_ranking(data, keys, fractions, set(nearest))
    return _by_counting(data, keys, fractions, set(nearest), accuracy, groups * len(fractions) <= BROADCAST_ROWS)


def _by_ranking(data: DataFrame, keys: list[str], fractions: Mapping[str, float], nearest: set[str]) -> DataFrame:
    """Groups that fit a task: distinct values with counts, ranked inside the group."""
    counted = data.groupBy(*keys, "__v").agg(F.count("__v").alias("__c"))
    group = Window.partitionBy(*keys)
    ranked = counted.select(
        *keys, "__v", F.sum("__c").over(group.orderBy("__v")).alias("__upto"), "__c", F.sum("__c").over(group).alias("__n")
    ).withColumn("__before", F.col("__upto") - F.col("__c"))
    wide = []
    for name, q in fractions.items():
        pos = _position(F.col("__n"), q, name in nearest)
        at = lambda rank: F.max(F.when((F.col("__before") <= rank) & (F.col("__upto") > rank), F.col("__v")))
        low, high = at(F.floor(pos)), at(F.ceil(pos))
        wide.append((low + (high - low) * F.max(pos - F.floor(pos))).alias(name))
    return ranked.groupBy(*keys).agg(*wide)


def _by_counting(
    data: DataFrame, keys: list[str], fractions: Mapping[str, float], nearest: set[str], accuracy: int, few: bool
) -> DataFrame:
    names = list(fractions)
    present = data.where(F.col("__v").isNotNull())
    sizes = [F.count("__v").alias("__n")]
    slack = 2.0 / accuracy
    lows = F.array(*[F.lit(max(0.0, fractions[n] - slack)) for n in names])
    highs = F.array(*[F.lit(min(1.0, fractions[n] + slack)) for n in names])
    sizes += [F.percentile_approx("__v", lows, accuracy).alias("__lo"),
              F.percentile_approx("__v", highs, accuracy).alias("__hi")]
    stats = data.groupBy(*keys).agg(*sizes)
    wanted = F.array(*[
        F.struct(
            F.lit(name).alias("__name"),
            _position(F.col("__n"), q, name in nearest).alias("__pos"),
            F.when(F.col("__n") >= 4 * accuracy, F.col("__lo")[i]).otherwise(F.lit(float("-inf"))).alias("__lo"),
            F.when(F.col("__n") >= 4 * accuracy, F.col("__hi")[i]).otherwise(F.lit(float("inf"))).alias("__hi"),
        )
        for i, (name, q) in enumerate(fractions.items())
    ])
    stats = stats.select(*keys, F.explode(wanted).alias("__w")).select(
        *keys, "__w.*"
    )
    renamed = stats.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__name", "__pos", "__lo", "__hi")
    renamed = F.broadcast(renamed) if few else renamed
    on = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)],
        F.lit(True),
    )
    joined = present.join(renamed, on, "inner") if keys else present.crossJoin(F.broadcast(renamed))
    inside = F.col("__v").between(F.col("__lo"), F.col("__hi"))
    # One shuffle keyed by (group, fraction, value): rows below the bracket shrink to one count per map task.
    counted = joined.where(F.col("__v") <= F.col("__hi")).groupBy(
        *keys, "__name", "__pos", F.when(inside, F.col("__v")).alias("__v")
    ).agg(F.count(F.lit(1)).alias("__c"))
    order = Window.partitionBy(*keys, "__name").orderBy(F.col("__v").asc_nulls_first())
    ranked = counted.withColumn("__upto", F.sum("__c").over(order)).withColumn(
        "__before", F.col("__upto") - F.col("__c")
    )
    lower, upper = F.floor("__pos"), F.ceil("__pos")
    covers = lambda rank: (F.col("__before") <= rank) & (F.col("__upto") > rank)
    picked = ranked.groupBy(*keys, "__name").agg(
        F.max(F.when(covers(lower), F.col("__v"))).alias("__a"),
        F.max(F.when(covers(upper), F.col("__v"))).alias("__b"),
        F.max(F.col("__pos") - lower).alias("__frac"),
    )
    missed = F.raise_error(F.lit("a quantile fell outside its bracket")).cast("double")
    value = F.coalesce(F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__frac"), missed)
    wide = picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("__name") == n, value)).alias(n) for n in names]
    )
    if not keys:
        return wide
    # Groups holding nulls only have no counted value; keep them with null quantiles.
    every = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    left = every.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    return left.join(wide, on, "left").select(
        *[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], *names
    )
