"""Row-based series columns per entity: lags, forward sums and events, trends.

Rows are ordered by time (then ``ties``). Frames count rows; heavy entities are cut into chunks of
consecutive rows with the neighbours a frame can reach copied in.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwise.functions import layout as lay
from tabwise.functions import scalars
from tabwise.operators.targets import with_next_event

US, POS = "__sus", "__pos"
# Hours reported when no further event follows; bounds of the trend in percent.
NO_EVENT_HOURS = 9999.0
TREND_BOUNDS = (-50.0, 100.0)
TREND_ROWS = 3


def over_rows(
    df: DataFrame, entity: str, time: str, before: int, after: int, build,
    ties: Sequence[str] = (), layout: lay.Layout | None = None, chunk_rows: int = lay.TASK_ROWS,
) -> DataFrame:
    """Add the columns of ``build(window) -> {name: Column}``; frames may reach ``before``/``after`` rows."""
    names = df.columns
    work = df.withColumn(US, scalars.micros(time))
    plan = lay.resolve(layout, work, [entity], F.col(US))
    work = lay.row_halo(work, [entity], US, ties, plan, before, after, chunk_rows)
    window = Window.partitionBy(entity, lay.BUCKET).orderBy(POS)
    added = build(window)
    return work.withColumns(added).where(F.col(lay.OWN)).select(*map(scalars.named, names), *added)


def lags(df, entity: str, time: str, column: str, steps: Sequence[int], default: Any = 0, **kw) -> DataFrame:
    """``{column}_lag_{k}``: the value k rows earlier, ``default`` where there is none."""
    def build(w):
        return {f"{column}_lag_{k}": F.lag(column, k, default).over(w) for k in steps}

    return over_rows(df, entity, time, max(steps), 0, build, **kw)


def _complete(w, rows: int, value: Column, strict: bool) -> Column:
    """Null where fewer than ``rows`` rows follow, unless partial frames are accepted."""
    return F.when(F.count(F.lit(1)).over(w.rowsBetween(1, rows)) == rows, value) if strict else value


def forward_sum(df, entity: str, time: str, column: str, rows: int, strict: bool = True, out: str | None = None, **kw):
    """Sum over the next ``rows`` rows, the current one excluded."""
    def build(w):
        total = F.sum(column).over(w.rowsBetween(1, rows))
        return {out or f"{column}_next_{rows}_sum": _complete(w, rows, total, strict)}

    return over_rows(df, entity, time, 0, rows, build, **kw)


def forward_any(df, entity: str, time: str, condition: Column, rows: int, out: str, strict: bool = False, **kw):
    """1 where the condition holds in any of the next ``rows`` rows."""
    def build(w):
        hit = F.coalesce(F.max(condition.cast("int")).over(w.rowsBetween(1, rows)), F.lit(0))
        return {out: _complete(w, rows, hit, strict)}

    return over_rows(df, entity, time, 0, rows, build, **kw)


def forward_risk(
    df, entity: str, time: str, level: str, threshold: float, state: str, bad_state: Any, rows: int, out: str, **kw
) -> DataFrame:
    """1 where the level falls below the threshold now or in the next rows, or the bad state is entered."""
    def build(w):
        low = F.min(level).over(w.rowsBetween(0, rows)) < F.lit(threshold)
        entered = F.max((F.col(state) == F.lit(bad_state)).cast("int")).over(w.rowsBetween(1, rows)) == 1
        return {out: (F.coalesce(low, F.lit(False)) | F.coalesce(entered, F.lit(False))).cast("int")}

    return over_rows(df, entity, time, 0, rows, build, **kw)


def trend_percent(df, entity: str, time: str, column: str, out: str | None = None, **kw) -> DataFrame:
    """Deviation in percent from the mean of the previous rows, bounded."""
    def build(w):
        past = F.avg(column).over(w.rowsBetween(-TREND_ROWS, -1))
        change = (F.col(column) - past) / F.greatest(past, F.lit(1.0)) * 100
        return {out or f"{column}_trend_pct": scalars.clip(change, *TREND_BOUNDS)}

    return over_rows(df, entity, time, TREND_ROWS, 0, build, **kw)


def time_to_next_event(
    df: DataFrame, entity: str, time: str, event: Column, out: str = "hours_to_event",
    default: float = NO_EVENT_HOURS, layout: lay.Layout | None = None,
) -> DataFrame:
    """Hours until the entity's next event: 0 at the event, ``default`` when none follows."""
    ahead = with_next_event(df, entity, time, event, "__event_us", include_current=True, layout=layout)
    hours = (F.col("__event_us") - scalars.micros(time)) / F.lit(3_600_000_000.0)
    return ahead.withColumn(out, F.coalesce(hours, F.lit(default))).drop("__event_us")


def rule_label(rules: Mapping[str, Column], otherwise: str) -> Column:
    """First rule that holds names the label."""
    cascade = reduce(
        lambda chain, item: chain.when(item[1], F.lit(item[0])), list(rules.items()), F
    )
    return cascade.otherwise(F.lit(otherwise))


coverage = scalars.ratio
composite_key = scalars.composite_key
