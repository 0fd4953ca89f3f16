import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tabwise.functions import cuts
from tabwise.operators import splits
from tabwise.plans.specs import DatasetSpec, SplitSpec


@pytest.fixture(scope="module")
def hundred(spark):
    rows = [(datetime(2024, 1, 1) + timedelta(minutes=i), "A", i) for i in range(100)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, id string, n int")


@pytest.mark.parametrize("time_key", ["ts", None])
def test_sizes_and_order(hundred, time_key):
    spec = DatasetSpec("d", "D", "id", time_key, split=SplitSpec())
    rows = splits.split_dataset(hundred, spec, ties=["n"]).toPandas()
    assert rows["split"].value_counts().to_dict() == {"train": 70, "validate": 15, "evaluation": 15}
    if time_key:
        latest = rows.groupby("split")["ts"].agg(["min", "max"])
        assert latest.loc["train", "max"] <= latest.loc["validate", "min"]
        assert latest.loc["validate", "max"] <= latest.loc["evaluation", "min"]


def rank_key(n, seed=42):
    return hashlib.md5(f"{n}|#{seed}".encode()).hexdigest()[:15]


@pytest.mark.parametrize("fanout, listed", [(4, 3), (4096, 8192)])
def test_ties_break_by_hash_and_sizes_stay_exact(spark, monkeypatch, fanout, listed):
    monkeypatch.setattr(cuts, "FANOUT", fanout)
    monkeypatch.setattr(cuts, "LISTED", listed)
    rows = [(datetime(2024, 1, 1 + i // 40), i) for i in range(200)] + [(None, 200)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, id int")
    got = {r.id: r.split for r in splits.assign_split(df, "id", "ts", (0.5, 0.3, 0.2)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or datetime.min, rank_key(r[1])))
    n = len(rows)
    for i, (_, key) in enumerate(order):
        want = "train" if i < int(n * 0.5) else "validate" if i < int(n * 0.7) else "evaluation"
        assert got[key] == want
    hashed = {r.id: r.split for r in splits.assign_split(df, "id", None, (0.5, 0.3, 0.2)).collect()}
    for i, (_, key) in enumerate(sorted(rows, key=lambda r: rank_key(r[1]))):
        assert hashed[key] == ("train" if i < int(n * 0.5) else "validate" if i < int(n * 0.7) else "evaluation")


def test_partitioning_does_not_change_a_random_split(hundred):
    a = {r.n: r.split for r in splits.assign_split(hundred, "n", None, (0.6, 0.4, 0)).collect()}
    b = {r.n: r.split for r in splits.assign_split(hundred.repartition(7), "n", None, (0.6, 0.4, 0)).collect()}
    c = {r.n: r.split for r in splits.assign_split(hundred, "n", None, (0.6, 0.4, 0), seed=1).collect()}
    assert a == b != c


def test_one_time_for_a_third_of_the_rows(spark):
    """A time value shared by a third of all rows is cut inside, not moved as a block."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(1500)).otherwise(F.col("id")).alias("m"), "id"
    ).withColumn("ts", F.timestamp_seconds(F.col("m") * 60))
    sizes = splits.assign_split(df, "id", "ts", (0.5, 0.25, 0.25)).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in sizes} == {"train": 1500, "validate": 750, "evaluation": 750}


def test_summary_periods_and_empty_split(hundred):
    divided = splits.assign_split(hundred, "n", "ts", (0.8, 0.2, 0.0))
    rows = {r.split: (r.row_count, r.pct) for r in splits.split_summary(divided).collect()}
    assert rows == {"train": (80, 0.8), "validate": (0, 0.0), "evaluation": (20, 0.2)}
    assert {r.split for r in splits.split_periods(divided, "ts").collect()} == {"train", "evaluation"}


def test_training_splits(hundred):
    sizes = lambda df: {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    spec = SplitSpec(train=0.6, validation=0.2, test=0.2)
    assert sizes(splits.chronological_split(hundred, "n", "ts", spec)) == {"train": 60, "validation": 20, "test": 20}
    assert sizes(splits.random_split(hundred, "n", spec)) == {"train": 60, "validation": 20, "test": 20}
    kept = int(100 * (0.6 / (0.6 + 0.2)))  # the cut is taken in floating point, here just below 75
    assert sizes(splits.carve_validation(hundred, "n", "ts", spec)) == {"train": kept, "validation": 100 - kept}


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_cuts_from_three_reads(spark, monkeypatch, accuracy):
    """The sketch only brackets: ranks are exact on tables above its size, with ties, and with brackets that miss."""
    monkeypatch.setattr(cuts, "ACCURACY", accuracy)
    monkeypatch.setattr(cuts, "ROUNDING", 0)
    rows = [((k * 7919) % 1000 if k % 3 else 5_000_000_000_000_000, k) for k in range(6000)]  # a third share one value
    df = spark.createDataFrame(rows, "o long, t long").repartition(5)
    fractions = [0.0, 0.3, 0.65, 0.8, 0.999, 1.0]
    order = sorted(rows)
    for fraction, (cut, tie_cut) in zip(fractions, cuts.sketched_cuts(df, "o", "t", fractions)):
        rank = int(6000 * fraction)
        kept = df.where(cuts.before_cut(F.col("o"), F.col("t"), cut, tie_cut)).collect()
        assert sorted(map(tuple, kept)) == order[:rank]
    assert cuts.sketched_cuts(df.limit(0), "o", "t", [0.5]) == [(None, None)]
    reads = []
    settle = cuts.settle
    monkeypatch.setattr(cuts, "settle", lambda part: reads.append(part) or settle(part))
    cuts.sketched_cuts(df, "o", "t", [0.3, 0.65])
    assert len(reads) == 1  # beside the sketch; what follows reads what was set aside
    if accuracy == 50:
        assert reads[0].count() < 6000
