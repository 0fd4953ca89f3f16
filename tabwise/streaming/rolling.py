"""Trailing-window features as observations arrive."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabwise.functions import moments, rank_index
from tabwise.operators.features import needs_history, select_features
from tabwise.operators.models import TrainedModel
from tabwise.plans import durations
from tabwise.plans.specs import DatasetSpec, FeatureSpec
from tabwise.streaming import state
from tabwise.streaming.labels import NEVER, entities
from tabwise.streaming.queues import Window
from tabwise.streaming.state import US

STREAMED = ("mean", "min", "max", "std", "median", "delta", "slope")
ELAPSED = "elapsed_time"


@dataclass(frozen=True)
class RollingWork:
    """Two stacks per window; the values of the longest median window as they are; the entity's first time."""

    wanted: tuple[tuple[str, str, str], ...]
    elapsed: bool
    whole: bool  # the key is an entity: it remembers its first time for good
    block: int = state.BLOCK

    @property
    def span(self) -> int:
        return max((durations.micros(w) for _, _, w in self.wanted), default=0)

    def arriving(self, processor, batch: pd.DataFrame) -> pd.DataFrame:
        return batch

    def step(self, memory, rows: pd.DataFrame, closed: int, blocks):
        merged = [t for t in self.wanted if t[1] != "median"]
        windows = list(dict.fromkeys(w for _, _, w in merged))
        columns = {w: list(dict.fromkeys(c for c, _, v in merged if v == w)) for w in windows}
        medians = [t for t in self.wanted if t[1] == "median"]
        if memory is None:
            memory = {"first": None, "recent": {}, "newest": None, "windows": [
                Window(durations.micros(w), len(columns[w]), k, self.block) for k, w in enumerate(windows)]}
        times = rows[US].to_numpy(dtype="int64")
        if len(rows):
            memory["first"] = int(times[0]) if memory["first"] is None else memory["first"]
            memory["newest"] = int(times[-1])
            first, group = state.points(times)
            seconds = ((times - memory["first"]) // 1_000_000).astype(float)
            values = {c: rows[c].to_numpy(dtype=float, na_value=np.nan) for c, _, _ in self.wanted}
            new = {c: moments.of_points(values[c], seconds, group) for c in {c for c, _, _ in merged}}
            for window, held in zip(windows, memory["windows"]):
                found = dict(zip(columns[window], held.advance(times[first], [new[c] for c in columns[window]], blocks)))
                for c, op, w in merged:
                    if w == window:
                        taken = moments.value(found[c], op)[group]
                        rows[f"{c}_{op}_{w}"] = values[c] - taken if op == "delta" else taken
            self._medians(memory["recent"], medians, times, values, first, group, rows)
            if self.elapsed:
                rows[ELAPSED] = seconds
        emitted = rows[rows[state.OWN].astype(bool)] if len(rows) else rows
        if memory["newest"] is None or closed < memory["newest"] + self.span:
            return emitted, memory, None if memory["newest"] is None else memory["newest"] + self.span
        # Nothing can look back to what is held; only the entity's first time stays.
        for held in memory["windows"]:
            held.clear(blocks)
        if not self.whole:
            return emitted, None, None
        fresh = [Window(durations.micros(w), len(columns[w]), k, self.block) for k, w in enumerate(windows)]
        return emitted, {"first": memory["first"], "recent": {}, "newest": None, "windows": fresh}, None

    @staticmethod
    def _medians(recent: dict, medians, times, values, first, group, rows) -> None:
        """Medians cannot be merged: the values of the longest window are read again."""
        for column in dict.fromkeys(c for c, _, _ in medians):
            spans = {w: durations.micros(w) for c, _, w in medians if c == column}
            held = recent.get(column, (np.zeros(0, np.int64), np.zeros(0)))
            at, v = np.concatenate((held[0], times)), np.concatenate((held[1], values[column]))
            distinct, codes = np.unique(np.where(np.isnan(v), 0.0, v), return_inverse=True)
            weight = (~np.isnan(v)).astype(np.int64)
            upto = np.concatenate(([0], np.cumsum(weight)))
            end = np.searchsorted(at, times[first], "right")
            for w, span in spans.items():
                start = np.searchsorted(at, times[first] - span, "right")
                total = upto[end] - upto[start]
                low, high = (distinct[np.minimum(rank_index.select(codes, weight, [(start, end)], np.maximum(r, 0)),
                                                 len(distinct) - 1)] for r in ((total - 1) // 2, total // 2))
                rows[f"{column}_median_{w}"] = np.where(total > 0, low + (high - low) * 0.5, np.nan)[group]
            keep = np.searchsorted(at, times[-1] - max(spans.values()), "right")
            recent[column] = (at[keep:], v[keep:])


class _Spaced:
    """Overflow blocks of one of a key's entities."""

    def __init__(self, blocks, number: int):
        self.blocks, self.base = blocks, number << 44

    def write(self, number: int, body) -> None:
        self.blocks.write(self.base + number, body)

    def take(self, number: int):
        return self.blocks.take(self.base + number)


@dataclass(frozen=True)
class GroupWork:
    """Windows of many entities at once.

    Entities with few rows in reach share arrays and one pass over them. One with more than ``block`` rows goes on with two
    stacks of its own, so that what is read again stays bounded.
    """

    single: RollingWork
    entity: str

    def arriving(self, processor, batch: pd.DataFrame) -> pd.DataFrame:
        return batch

    def step(self, memory, rows: pd.DataFrame, closed: int, blocks):
        memory = memory or {"light": None, "heavy": {}, "newest": None}
        if len(rows):
            memory["newest"] = max(int(rows[US].iloc[-1]), -NEVER if memory["newest"] is None else memory["newest"])
            rows = self._computed(memory, rows, closed, blocks)
        emitted = rows[rows[state.OWN].astype(bool)] if len(rows) else rows
        if memory["newest"] is None:
            return emitted, None, None
        if closed < memory["newest"] + self.single.span:
            return emitted, memory, memory["newest"] + self.single.span
        for number, held in memory["heavy"].values():
            for window in held["windows"]:
                window.clear(_Spaced(blocks, number))
        return emitted, None, None

    def _computed(self, memory, rows: pd.DataFrame, closed: int, blocks) -> pd.DataFrame:
        heavy, before = memory["heavy"], 0 if memory["light"] is None else len(memory["light"])
        every = rows if not before else pd.concat([memory["light"], rows], ignore_index=True)
        new = np.arange(len(every)) >= before
        codes, names = entities(every[self.entity])
        own = (np.bincount(codes, minlength=len(names)) > self.single.block) | np.array([who in heavy for who in names])
        parts = []
        for code in np.flatnonzero(own):
            mine = codes == code
            number, held = heavy.get(names[code], (len(heavy) + 1, None))
            for part in (every[mine & ~new], every[mine & new]):
                if len(part):
                    part = part.sort_values(US, kind="stable").reset_index(drop=True)
                    emitted, held, _ = self.single.step(held, part, -NEVER, _Spaced(blocks, number))
            heavy[names[code]] = number, held
            if (mine & new).any():
                parts.append(emitted)
        light = np.flatnonzero(~own[codes])
        if len(light):
            order = light[np.lexsort((every[US].to_numpy(dtype="int64")[light], codes[light]))]
            parts.append(self._light(every.iloc[order].reset_index(drop=True), codes[order])[new[order]])
        reach = every[~own[codes] & (every[US].to_numpy(dtype="int64") > closed - self.single.span)]
        memory["light"] = reach[list(dict.fromkeys([self.entity, US, *[c for c, _, _ in self.single.wanted]]))] if len(reach) else None
        return pd.concat(parts, ignore_index=True)

    def _light(self, rows: pd.DataFrame, codes: np.ndarray) -> pd.DataFrame:
        """Rows lie together by entity, in time order; entities are set apart on one axis by more than any window."""
        times = rows[US].to_numpy(dtype="int64")
        times = times - times.min()
        apart = int(times.max()) + self.single.span + 1
        most = max(1, (1 << 62) // apart)
        if codes[-1] - codes[0] >= most:  # too many for one axis
            cut = int(np.searchsorted(codes, codes[0] + most))
            head, tail = (rows.iloc[p].reset_index(drop=True) for p in (slice(None, cut), slice(cut, None)))
            return pd.concat([self._light(head, codes[:cut]), self._light(tail, codes[cut:])], ignore_index=True)
        times = times + (codes - codes[0]).astype(np.int64) * apart
        first, group = state.points(times)
        at = times[first]
        values = {c: rows[c].to_numpy(dtype=float, na_value=np.nan) for c, _, _ in self.single.wanted}
        found = {}
        for c, op, w in self.single.wanted:
            if op == "median":
                continue
            if (c, w) not in found:
                whole = moments.of_points(values[c], np.zeros(len(times)), group)
                start = np.searchsorted(at, at - durations.micros(w), "right")
                kept = {k: whole[k] for k in ("n", "ym", "y2", "low", "high")}
                found[c, w] = moments.windows(kept, start, np.arange(1, len(at) + 1))
            taken = moments.value(found[c, w], op)[group]
            rows[f"{c}_{op}_{w}"] = values[c] - taken if op == "delta" else taken
        self.single._medians({}, [t for t in self.single.wanted if t[1] == "median"], times, values, first, group, rows)
        return rows


def rolling_features(
    stream: DataFrame, dataset: DatasetSpec, spec: FeatureSpec, keep: list[str] | None = None,
    delay: str = "1 hour", bucket: str = "1d", block: int = state.BLOCK,
) -> DataFrame:
    """Features of every row once the watermark has passed it, equal to the batch features of closed rows.

    State of a group of entities in a bucket: the points of its longest window. ``slope`` and ``elapsed_time`` count from an entity's first row;
    with them a bucket is an entity, which then remembers that time and is not spread.
    """
    wanted = [(c, t.op, w) for c, t in spec.items() if needs_history(t.op) for w in t.windows]
    elapsed = any(t.op == ELAPSED for _, t in spec.items())
    unknown = [op for _, op, _ in wanted if op not in STREAMED]
    if unknown or not (wanted or elapsed):
        raise ValueError(f"streamed windows are {', '.join(STREAMED)}; got {unknown or 'none'}")
    whole = elapsed or any(op == "slope" for _, op, _ in wanted)
    work = RollingWork(tuple(wanted), elapsed, whole, block)
    width = None if whole else max(durations.micros(bucket), work.span)
    columns = list(dict.fromkeys([dataset.entity_key, dataset.time_key, *(keep or []), *[c for c, _, _ in wanted]]))
    outputs = [T.StructField(f"{c}_{op}_{w}", T.DoubleType()) for c, op, w in wanted]
    outputs += [T.StructField(ELAPSED, T.DoubleType())] * elapsed
    placed = state.keyed(stream, dataset.entity_key, dataset.time_key, width, max(work.span - 1, 0), 0, delay)
    work = work if whole else GroupWork(work, dataset.entity_key)
    return state.run(placed, dataset.entity_key, dataset.time_key, columns, work, outputs, grouped=not whole)


def score_stream(
    stream: DataFrame, model: TrainedModel, keep: list[str] | None = None, delay: str = "1 hour", bucket: str = "1d"
) -> DataFrame:
    """Prediction of every row once the watermark has passed it; the model and its fitted state stay as they are."""
    dataset, spec = model.config.dataset, model.config.features
    sources = [c for c in spec.source_columns() if c not in dataset.keys]
    held = list(dict.fromkeys([*(keep or []), *sources]))
    closed = rolling_features(stream, dataset, spec, held, delay, bucket)
    kept = {f"{c}_{t.op}_{w}" for c, t in spec.items() if needs_history(t.op) for w in t.windows}
    kept |= {ELAPSED} & set(closed.columns)
    ready, _ = select_features(closed, dataset, spec, model.fitted, keep or [], {n: n for n in kept})
    outputs = ["prediction"] + ([] if model.regression else ["predicted_label"])
    return model.transform(ready).select(*dataset.keys, *(keep or []), *outputs)
