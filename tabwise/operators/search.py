"""Parametric search: expand → filter → sort → project → limit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwise.operators import filters as flt
from tabwise.plans.specs import DatasetSpec, SearchSpec

# Bounds of the limit feature.
MIN_LIMIT, MAX_LIMIT = 1, 1000


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False

    def column(self) -> Column:
        return F.desc_nulls_first(self.field) if self.descending else F.asc_nulls_first(self.field)


@dataclass(frozen=True)
class SearchResult:
    rows: DataFrame
    matching: DataFrame
    applied: list[dict[str, Any]]

    def matched(self) -> int:
        """Rows matching before the limit; a separate count, run only when asked for."""
        return self.matching.count()


def clamp_limit(limit: int) -> int:
    return max(MIN_LIMIT, min(int(limit), MAX_LIMIT))


def _sorts(sort) -> list[Sort]:
    return [s if isinstance(s, Sort) else Sort(**s) for s in sort or []]


def search(
    df: DataFrame,
    filters=None,
    sort: Sequence[Sort] | None = None,
    limit: int = 50,
    columns: Sequence[str] | None = None,
    spec: SearchSpec | None = None,
    tie_break: Sequence[str] = (),
) -> SearchResult:
    concrete = flt.expand(flt.normalize(filters), spec)
    found = flt.apply(df, concrete)
    order = _sorts(sort)
    flt.check_columns(df, [s.field for s in order], "sort column")
    flt.check_columns(df, list(columns or []), "columns")
    rows = found
    if order or tie_break:
        rows = rows.orderBy(*[s.column() for s in order], *[F.asc_nulls_first(t) for t in tie_break])
    rows = rows.limit(clamp_limit(limit))
    if columns:
        rows = rows.select(*columns)
    return SearchResult(rows, found, [f.audit() for f in concrete])


def sample_rows(
    df: DataFrame, n: int = 20, filters=None, columns: Sequence[str] | None = None,
    sort_by: str | None = None, descending: bool = False, tie_break: Sequence[str] = (),
) -> DataFrame:
    """Raw rows under simple filters and one sort key."""
    order = [Sort(sort_by, descending)] if sort_by else None
    return search(df, filters, order, n, columns, tie_break=tie_break).rows


def select_roles(df: DataFrame, spec: DatasetSpec, *roles: str) -> DataFrame:
    """Projection by declared role, in declaration order; absent columns are left out."""
    wanted = [c.name for c in spec.columns.values() if c.role in roles and c.name in df.columns]
    return df.select(*wanted)
