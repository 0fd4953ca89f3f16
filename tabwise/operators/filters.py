"""Typed predicates and named semantic filters, turned into one Column before any scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwise.functions.scalars import named
from tabwise.plans.specs import SearchSpec

# The operators of a filter.
OPERATORS = ("eq", "in", "gte", "lte", "between", "contains_range", "semantic")
# Longer value lists are joined instead of inlined in the plan.
INLINE_VALUES = 10_000


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: Any = None
    min_field: str | None = None
    max_field: str | None = None
    low: float | None = None
    high: float | None = None

    def __post_init__(self):
        if self.op not in OPERATORS:
            raise ValueError(f"unknown filter operator {self.op!r}; use one of {', '.join(OPERATORS)}")
        needs = {
            "contains_range": ("min_field", "max_field", "value"),
            "between": ("low", "high"),
            "eq": ("value",), "gte": ("value",), "lte": ("value",), "in": ("value",),
        }.get(self.op, ())
        absent = [n for n in needs if getattr(self, n) is None]
        if absent:
            raise ValueError(f"filter {self.op!r} on {self.field!r} needs {', '.join(absent)}")
        if self.op == "in" and not isinstance(self.value, (list, tuple)):
            raise ValueError(f"filter 'in' on {self.field!r} needs a list of values")

    @property
    def columns(self) -> list[str]:
        return [self.min_field, self.max_field] if self.op == "contains_range" else [self.field]

    def predicate(self) -> Column:
        column = F.col(self.field)
        match self.op:
            case "eq":
                return column == F.lit(self.value)
            case "in":
                return column.isin(list(self.value))
            case "gte":
                return column >= F.lit(self.value)
            case "lte":
                return column <= F.lit(self.value)
            case "between":
                return column.between(F.lit(self.low), F.lit(self.high))
            case "contains_range":
                v = F.lit(self.value)
                return (F.col(self.min_field) <= v) & (F.col(self.max_field) >= v)
        raise ValueError(f"semantic filter {self.field!r} has not been expanded")

    def audit(self) -> dict[str, Any]:
        return {
            "field": self.field, "op": self.op, "value": self.value, "min_field": self.min_field,
            "max_field": self.max_field, "low": self.low, "high": self.high,
        }


def from_mapping(simple: Mapping[str, Any] | None) -> list[Filter]:
    """``{column: scalar}`` means equality, ``{column: [values]}`` means membership."""
    return [
        Filter(name, "in" if isinstance(v, (list, tuple)) else "eq", v) for name, v in (simple or {}).items()
    ]


def normalize(filters) -> list[Filter]:
    """Accept Filter objects, filter dicts, or one simple ``{column: value}`` mapping."""
    if filters is None or isinstance(filters, Mapping):
        return from_mapping(filters)
    return [f if isinstance(f, Filter) else Filter(**f) for f in filters]


def expand(filters: Sequence[Filter], spec: SearchSpec | None) -> list[Filter]:
    """Replace semantic references by concrete filters and aliases by their columns."""
    semantics = spec.semantics if spec else {}
    concrete: list[Filter] = []
    for f in filters:
        rule = semantics.get(f.field)
        if rule is None:
            if f.op == "semantic":
                raise ValueError(f"unknown semantic filter {f.field!r}; available: {sorted(semantics)}")
            concrete.append(_canonical(f, spec))
        elif rule.type == "range_contains":
            if f.value is None:
                raise ValueError(f"semantic filter {f.field!r} needs a value")
            concrete.append(Filter(rule.min_field, "contains_range", f.value, rule.min_field, rule.max_field))
        elif rule.type == "expands_to":
            concrete.extend(Filter(**part) for part in rule.expands_to)
        else:
            raise ValueError(f"semantic filter {f.field!r} is of unknown type {rule.type!r}")
    return concrete


def _canonical(f: Filter, spec: SearchSpec | None) -> Filter:
    if spec is None or spec.canonical(f.field) == f.field:
        return f
    return Filter(**{**f.audit(), "field": spec.canonical(f.field)})


def check_columns(df: DataFrame, names: Sequence[str], what: str) -> None:
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"unknown {what}: {unknown}")


def apply(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """AND of all filters; every name is checked before anything runs."""
    check_columns(df, [c for f in filters for c in f.columns], "filter column")
    long_lists = [f for f in filters if f.op == "in" and len(f.value) > INLINE_VALUES]
    inline = [f.predicate() for f in filters if f not in long_lists]
    if inline:
        df = df.where(reduce(lambda a, b: a & b, inline))
    for f in long_lists:
        listed = [v for v in f.value if v is not None]
        if any(isinstance(v, float) for v in listed):
            listed = [float(v) for v in listed]
        if not listed:
            df = df.where(F.lit(False))
            continue
        values = df.sparkSession.createDataFrame([(v,) for v in listed]).toDF("__listed")
        df = df.join(values, named(f.field) == F.col("__listed"), "left_semi")
    return df


def matching(df: DataFrame, filters) -> DataFrame:
    return apply(df, normalize(filters))
