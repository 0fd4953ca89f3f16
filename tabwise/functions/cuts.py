"""Exact rank cuts: the value below which a given number of rows lie.

``sketched_cuts`` reads a table three times: a mergeable rank sketch brackets every cut, the rows inside the brackets are set
aside, and those below are counted. What is set aside is a small part of the table, and cuts are found in it.

Every round there (``find_cuts``) is one job for all cuts: it counts rows in at most ``FANOUT`` equal slices of each interval
that still holds a cut and keeps one slice per cut. Once an interval holds few rows its values are listed. The driver
sees counts and at most ``LISTED`` values per cut, and no task sees a global order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwise.session import settle

FANOUT = 4096
LISTED = 8192
# Rank error of the sketch is at most rows / ACCURACY. It works on doubles, which carry 53 of 64 bits.
ACCURACY = 10_000
ROUNDING = 1 << 11


@dataclass(frozen=True)
class Cut:
    """Value holding 0-based ``rank``: ``below`` rows are smaller, ``remainder`` ranks lie inside the value."""

    value: int
    below: int
    remainder: int


@dataclass(frozen=True)
class _Interval:
    low: int
    high: int
    below: int
    rows: int
    ranks: tuple[int, ...]

    @property
    def step(self) -> int:
        return 1 if self.rows <= LISTED else -(-(self.high - self.low + 1) // FANOUT)


def extent(df: DataFrame, column: str) -> tuple[int, int, int]:
    """(rows, smallest, largest) of a long column in one pass."""
    n, low, high = df.agg(F.count(F.lit(1)), F.min(column), F.max(column)).first()
    return n, low or 0, high or 0


def find_cuts(
    df: DataFrame, column: str, ranks: Sequence[int], known: tuple[int, int, int] | None = None
) -> dict[int, Cut]:
    """Cuts of a non-null long column for ranks in ``[0, n)``; ``known`` is its extent where already measured."""
    wanted = tuple(sorted(set(ranks)))
    if not wanted:
        return {}
    rows, low, high = known or extent(df, column)
    found: dict[int, Cut] = {}
    active = [_Interval(low, high, 0, rows, wanted)]
    while active:
        for done in [i for i in active if i.low == i.high]:
            found |= {r: Cut(done.low, done.below, r - done.below) for r in done.ranks}
        active = [i for i in active if i.low != i.high]
        if active:
            active = _round(df, column, active)
    return found


def _round(df: DataFrame, column: str, active: list[_Interval]) -> list[_Interval]:
    x = F.col(column)
    inside = [x.between(i.low, i.high) for i in active]
    slots = [F.expr(f"({column} - ({i.low}L)) div {i.step}L") for i in active]
    which = reduce(lambda c, k: c.when(inside[k], F.lit(k)), range(len(active)), F)
    slot = reduce(lambda c, k: c.when(inside[k], slots[k]), range(len(active)), F)
    # The extremes of a slice tighten the next interval to values that exist.
    counted = df.where(reduce(lambda a, b: a | b, inside)).groupBy(which.alias("i"), slot.alias("s")).agg(
        F.count(F.lit(1)), F.min(x), F.max(x)
    ).collect()
    narrowed = []
    for k, interval in enumerate(active):
        below = interval.below
        for _, _, n, low, high in sorted(r for r in counted if r[0] == k):
            here = tuple(r for r in interval.ranks if below <= r < below + n)
            if here:
                narrowed.append(_Interval(low, high, below, n, here))
            below += n
    return narrowed


def sketched_cuts(
    df: DataFrame, column: str, tie: str | None, fractions: Sequence[float]
) -> list[tuple[Cut | None, Cut | None]]:
    """Per fraction f, the cut at rank ``int(rows * f)`` of a non-null long column, and the cut inside its value by ``tie``.

    A fraction of 1 has no cut. Three reads of ``df``, whatever its size and ties.
    """
    slack = 2.0 / ACCURACY
    edges = [min(1.0, max(0.0, f + d)) for f in fractions for d in (-slack, slack)]
    n, low, high, marks = df.agg(
        F.count(F.lit(1)), F.min(column), F.max(column), F.percentile_approx(column, edges, ACCURACY)).first()
    if not n:
        return [(None, None) for _ in fractions]
    ranks = [int(n * f) for f in fractions]
    exact = n < 4 * ACCURACY  # few rows: all of them are looked at
    around = [(low, high) if exact else (marks[2 * k] - ROUNDING, marks[2 * k + 1] + ROUNDING) for k in range(len(ranks))]
    wanted = [k for k, r in enumerate(ranks) if r < n]
    if not wanted:
        return [(None, None) for _ in fractions]
    x = F.col(column)
    inside = reduce(lambda a, b: a | b, [x.between(*around[k]) for k in wanted])
    aside = settle(df.where(inside))
    counts = df.agg(*[F.count_if(x < around[k][0]).alias(f"below{k}") for k in wanted],
                    *[F.count_if(x <= around[k][1]).alias(f"upto{k}") for k in wanted]).first()
    found: list[tuple[Cut | None, Cut | None]] = [(None, None) for _ in fractions]
    for k in wanted:
        below, upto, rank = counts[f"below{k}"], counts[f"upto{k}"], ranks[k]
        if below <= rank < upto:
            cut = find_cuts(aside.where(x.between(*around[k])), column, [rank - below])[rank - below]
            cut = Cut(cut.value, cut.below + below, cut.remainder)
        else:  # the sketch has missed its bound
            cut = find_cuts(df, column, [rank])[rank]
        tie_cut = None
        if tie and cut.remainder:
            same = (aside if below <= rank < upto else df).where(x == F.lit(cut.value)).select(tie)
            tie_cut = find_cuts(same, tie, [cut.remainder])[cut.remainder]
        found[k] = (cut, tie_cut)
    return found


def before_cut(order: Column, tie: Column, cut: Cut | None, tie_cut: Cut | None) -> Column:
    """Rows ranked before the cut in (order, tie)."""
    if cut is None:
        return F.lit(True)
    if tie_cut is None:
        return order < F.lit(cut.value)
    return (order < F.lit(cut.value)) | ((order == F.lit(cut.value)) & (tie < F.lit(tie_cut.value)))
