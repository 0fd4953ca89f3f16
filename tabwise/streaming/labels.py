"""Labels that become known later: an event of the same entity within the horizon."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise.plans import durations
from tabwise.plans.specs import DatasetSpec, TargetSpec
from tabwise.streaming import state
from tabwise.streaming.state import BLOCK, US

HIT = "positive_row"
NEVER = np.iinfo(np.int64).max


def entities(column: pd.Series) -> tuple[np.ndarray, list]:
    """(number of every row's entity, entities by number); null is one."""
    codes, found = pd.factorize(column, use_na_sentinel=False)
    return codes, [None if pd.isna(v) else v for v in found.tolist()]


@dataclass(frozen=True)
class LabelWork:
    """Pending rows of many entities in time order, in blocks that know each entity's first event, and the next event of
    later buckets.

    A row is labelled when it leaves: by its entity's first event after it among the rows that are still pending, all of
    which are later, or by the one event that the following buckets have told of.
    """

    name: str
    entity: str
    horizon: int
    block: int = BLOCK

    def arriving(self, processor, batch: pd.DataFrame) -> pd.DataFrame:
        own = batch[state.OWN].astype(bool)
        if not own.all():
            memory = processor.remembered() or self.fresh()
            later = memory["later"]
            for who, us in self._firsts(batch[~own]).items():
                later[who] = min(us, later.get(who, NEVER))
            processor.remember(memory)
            processor.wake(max(later.values()) + 1000)  # forgotten then, if nobody asked
        return batch[own]

    @staticmethod
    def fresh() -> dict:
        # Blocks as (number, first event of each entity), oldest first; the newest block is held open.
        return {"blocks": [], "open": None, "later": {}, "next": 0}

    def _firsts(self, part: pd.DataFrame) -> dict:
        hits = part[part[HIT].astype(bool)]
        codes, names = entities(hits[self.entity])
        first = np.full(len(names), NEVER)
        np.minimum.at(first, codes, hits[US].to_numpy(dtype="int64"))
        return dict(zip(names, first.tolist()))

    def step(self, memory, rows: pd.DataFrame, closed: int, blocks):
        memory = memory or self.fresh()
        if len(rows):
            held = rows if memory["open"] is None else pd.concat([memory["open"], rows], ignore_index=True)
            for start in range(0, len(held) // self.block * self.block, self.block):
                part = held.iloc[start:start + self.block]
                memory["next"] += 1
                memory["blocks"].append((memory["next"], self._firsts(part)))
                blocks.write(memory["next"], part)
            rest = held.iloc[len(held) // self.block * self.block:].reset_index(drop=True)
            memory["open"] = rest if len(rest) else None
        due, parts, left = closed - self.horizon, [], None
        while memory["blocks"] or memory["open"] is not None:
            if memory["blocks"]:
                part = blocks.take(memory["blocks"].pop(0)[0])
            else:
                part, memory["open"] = memory["open"], None
            leaving = (part[US] <= due).to_numpy()
            if leaving.any():
                parts.append(part[leaving])
            if not leaving.all():
                left = part[~leaving].reset_index(drop=True)
                break
        if left is not None:
            self._put_back(memory, left, blocks)
        emitted = pd.concat(parts, ignore_index=True) if parts else rows.iloc[:0].assign(**{self.name: 0})
        if parts:
            emitted[self.name] = self._labels(emitted, self._next_events(memory))
        if left is not None:
            return emitted, memory, int(left[US].iloc[0]) + self.horizon
        memory["later"] = {who: us for who, us in memory["later"].items() if us >= closed}
        if not memory["later"]:
            return emitted, None, None
        return emitted, memory, max(memory["later"].values()) + 1000

    def _put_back(self, memory: dict, left: pd.DataFrame, blocks) -> None:
        if not memory["blocks"] and memory["open"] is None:
            memory["open"] = left
            return
        memory["next"] += 1
        memory["blocks"].insert(0, (memory["next"], self._firsts(left)))
        blocks.write(memory["next"], left)

    def _next_events(self, memory: dict) -> dict:
        """First event of each entity after the rows that leave; a later bucket's is certainly after all of this one's."""
        found = dict(memory["later"])
        if memory["open"] is not None:
            found |= self._firsts(memory["open"])
        for _, firsts in reversed(memory["blocks"]):
            found |= firsts
        return found

    def _labels(self, leaving: pd.DataFrame, following: dict) -> np.ndarray:
        times, hit = leaving[US].to_numpy(dtype="int64"), leaving[HIT].astype(bool).to_numpy()
        codes, names = entities(leaving[self.entity])
        told = [(code, following[who]) for code, who in enumerate(names) if who in following]
        who = np.concatenate((codes[hit], np.array([c for c, _ in told], np.int64)))
        when = np.concatenate((times[hit], np.array([t for _, t in told], np.int64)))
        distinct, place = np.unique(np.concatenate((times, when)), return_inverse=True)
        rank = lambda code, at: code.astype(np.int64) * len(distinct) + at  # by entity, then by time
        keys = rank(who, place[len(times):])
        order = np.argsort(keys, kind="stable")
        after = np.searchsorted(keys[order], rank(codes, place[:len(times)]), "right")
        known = after < len(keys)
        next_one = order[after[known]]
        out = np.zeros(len(times), "int8")
        out[known] = (who[next_one] == codes[known]) & (when[next_one] - times[known] <= self.horizon)
        return out


def delayed_labels(
    stream: DataFrame, dataset: DatasetSpec, target: TargetSpec, keep: list[str] | None = None,
    delay: str = "1 hour", bucket: str = "1d", block: int = BLOCK,
) -> DataFrame:
    """Emit a row with its label when the watermark has passed its time plus the horizon.

    State of a group of entities in a bucket: its pending rows, and per entity one event of the buckets after it. Only positive rows are copied to the bucket
    before theirs, which keeps the earliest, so pairs of rows and events never form.
    """
    if target.horizon_micros is None:
        raise ValueError(f"target {target.name!r}: a future event needs a horizon")
    horizon = target.horizon_micros
    hit = F.coalesce(F.col(target.source_column) == F.lit(target.positive_class), F.lit(False))
    columns = list(dict.fromkeys([dataset.entity_key, dataset.time_key, *(keep or []), HIT]))
    placed = state.keyed(
        stream.withColumn(HIT, hit), dataset.entity_key, dataset.time_key,
        max(durations.micros(bucket), horizon), 0, horizon, delay, halo_filter=F.col(HIT),
    )
    out = state.run(placed, dataset.entity_key, dataset.time_key, columns, LabelWork(target.name, dataset.entity_key, horizon, block),
                    [T.StructField(target.name, T.ByteType())], grouped=True)
    return out.drop(HIT)
