"""Train / validation / evaluation splits with exact sizes and no global sort.

Rows are ranked by (time, hash of the tie columns), or by hash alone for a random split; the two
cut points come from three reads of the table (see functions/cuts.py), after which the split is a comparison
per row. Rows equal in time and in every tie column are never separated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwise.functions import cuts, scalars
from tabwise.plans.specs import DatasetSpec, SplitSpec

# Partition names in order of time, and the seed of random splits.
TRAIN, VALIDATE, EVALUATION = "train", "validate", "evaluation"
NAMES = (TRAIN, VALIDATE, EVALUATION)
SEED = 42

Shares = tuple[float, float, float]


def normalize(train: float, evaluation: float, validate: float) -> Shares:
    total = train + evaluation + validate
    if total <= 0:
        raise ValueError(f"split shares must sum to more than 0, not {total}")
    return train / total, evaluation / total, validate / total


def resolve_shares(split: SplitSpec, fallback: Shares | None = None) -> Shares:
    """(train, evaluation, validate) summing to 1.

    A declared ``train`` of 1 means no split; then ``fallback`` shares apply where given.
    """
    if split.train < 1.0:
        return normalize(split.train, split.test, split.validation)
    return normalize(*(fallback or (1.0, 0.0, 0.0)))


def assign_split(
    df: DataFrame,
    entity_key: str,
    time_key: str | None,
    shares: Shares,
    ties: Sequence[str] | None = None,
    seed: int = SEED,
    out: str = "split",
    names: Sequence[str] = NAMES,
) -> DataFrame:
    """Add the split column. Chronological when the table has the time key, otherwise hashed-random."""
    train, evaluation, validate = normalize(*shares)
    tie = scalars.stable_hash(*(ties or [entity_key]), seed=seed)
    chronological = bool(time_key and time_key in df.columns)
    # Rows without a time come first, as null times sort.
    order = F.coalesce(scalars.micros(time_key), F.lit(-(2**61))) if chronological else tie
    ranked = df.select(order.alias("__order"), tie.alias("__tie")) if chronological else df.select(
        order.alias("__order")
    )
    found = cuts.sketched_cuts(ranked, "__order", "__tie" if chronological else None, [train, train + validate])
    bounds = [cuts.before_cut(order, tie, *cut) for cut in found]
    first, second, third = names
    return df.withColumn(
        out, F.when(bounds[0], F.lit(first)).when(bounds[1], F.lit(second)).otherwise(F.lit(third))
    )


def split_dataset(df: DataFrame, spec: DatasetSpec, fallback: Shares | None = None, **kw) -> DataFrame:
    return assign_split(df, spec.entity_key, spec.time_key, resolve_shares(spec.split, fallback), **kw)


def chronological_split(df: DataFrame, entity_key: str, time_key: str, split: SplitSpec, **kw) -> DataFrame:
    """Train / validation / test labels for model training, oldest first."""
    shares = (split.train, split.test, split.validation)
    return assign_split(df, entity_key, time_key, shares, names=("train", "validation", "test"), **kw)


def random_split(df: DataFrame, key: str, split: SplitSpec, seed: int = SEED, **kw) -> DataFrame:
    shares = (split.train, split.test, split.validation)
    return assign_split(df, key, None, shares, seed=seed, names=("train", "validation", "test"), **kw)


def carve_validation(
    df: DataFrame, entity_key: str, time_key: str | None, split: SplitSpec, **kw
) -> DataFrame:
    """Split a train partition again into train and validation, shares renormalised."""
    validation = split.validation if split.validation > 0 else split.test
    return assign_split(
        df, entity_key, time_key, (split.train, 0.0, validation), names=("train", "validation", "validation"), **kw
    )


def split_summary(df: DataFrame, split: str = "split", names: Sequence[str] = NAMES) -> DataFrame:
    """Rows and rounded share per split; splits without rows are listed with 0."""
    counted = df.groupBy(split).agg(F.count(F.lit(1)).alias("row_count"))
    total = counted.agg(F.sum("row_count").alias("total"))
    listed = df.sparkSession.createDataFrame([(n,) for n in names], f"{split} string")
    rows = F.coalesce("row_count", F.lit(0))
    return (
        listed.join(F.broadcast(counted), split, "left")  # one row per split
        .crossJoin(F.broadcast(total))
        .select(split, rows.alias("row_count"),
                F.coalesce(F.round(rows / F.when(F.col("total") > 0, F.col("total")), 4), F.lit(0.0)).alias("pct"))
    )


def split_periods(df: DataFrame, time: str, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.min(time).alias("period_start"), F.max(time).alias("period_end"))
