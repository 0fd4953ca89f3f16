"""Scalar helpers shared by the operators; all are Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def named(name: str) -> Column:
    """Column of exactly this name: category and header names may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_column(value: str | Column) -> Column:
    return named(value) if isinstance(value, str) else value


def micros(time: str | Column) -> Column:
    """Event time as whole microseconds since the epoch (session time zone is UTC)."""
    return F.unix_micros(as_column(time).cast("timestamp"))


def from_micros(us: str | Column) -> Column:
    return F.timestamp_micros(as_column(us))


def shift_time(time: str | Column, by_micros: int) -> Column:
    return F.timestamp_micros(micros(time) + F.lit(by_micros))


def hour_of_day(time: str | Column) -> Column:
    return F.hour(as_column(time)).cast("double")


def day_of_week(time: str | Column) -> Column:
    """1 = Monday … 7 = Sunday."""
    return (F.weekday(as_column(time)) + 1).cast("double")


def lenient(column: str | Column, data_type: str) -> Column:
    """Cast that yields null instead of failing."""
    return as_column(column).try_cast(data_type)


def lenient_timestamp(column: str | Column) -> Column:
    return F.try_to_timestamp(as_column(column))


def is_true(column: str | Column, positive) -> Column:
    """``column == positive`` as a tinyint; null stays null."""
    return (as_column(column) == F.lit(positive)).cast("tinyint")


def ratio(numerator: str | Column, denominator: str | Column, digits: int | None = 2) -> Column:
    """``numerator / max(denominator, 1)``, rounded: coverage and backlog style columns."""
    value = as_column(numerator) / F.greatest(as_column(denominator), F.lit(1.0))
    return value if digits is None else F.round(value, digits)


def clip(column: str | Column, low: float, high: float) -> Column:
    value = as_column(column)
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def composite_key(*columns: str | Column) -> Column:
    return F.concat_ws("__", *[as_column(c) for c in columns])


def onehot_source(feature: str | Column) -> Column:
    """Source column of ``{source}__{category}``: everything before the last ``__``."""
    return F.regexp_extract(as_column(feature), r"^(.*)__(.*)$", 1)


def onehot_category(feature: str | Column) -> Column:
    return F.regexp_extract(as_column(feature), r"^(.*)__(.*)$", 2)


def strip_current(feature: str | Column) -> Column:
    return F.regexp_replace(as_column(feature), "_current$", "")


def onehot_name(source: str, category) -> str:
    return f"{source}__{category}"


def text_value(column: str | Column) -> Column:
    return as_column(column).cast(T.StringType())


def stable_hash(*columns: str | Column, seed: int = 42) -> Column:
    """60-bit order key from an md5 over the columns: the same on any partitioning and in any engine."""
    text = F.concat_ws("|", *[as_column(c).cast("string") for c in columns], F.lit(f"#{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
