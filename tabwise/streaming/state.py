"""Keyed state shared by the streaming operators.

Streams are keyed by (entity, time bucket) with the same halo as the batch windows: a row also goes to the
bucket whose rows may look back (or ahead) to it. A heavy entity is thus spread over its buckets, and the state
of a bucket is dropped when the watermark has passed everything it can still emit. Operators that need all of an
entity's past take one bucket per entity. Operators that can take many entities at once are keyed by (group of entities,
bucket) instead, as a key costs milliseconds however few rows it has.

Rows wait until the watermark has passed them; from then on they are final and are taken in time order. What is kept of
them lies in blocks of a bounded number of entries, so that a row is written and read a bounded number of times.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tabwise.functions import layout as lay
from tabwise.functions import scalars

# Rows of one bucket: event time in microseconds, and whether the bucket emits the row.
# Their names start with a letter: the Python side of the stateful operator renames others.
US, OWN, BUCKET, GROUP = "time_us", "own_row", "bucket_id", "entity_group"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BLOCK = 512
# Groups that entities are dealt to, by hash.
GROUPS = 256


class Blocks:
    """Overflow blocks of a key: numbered entries of a map state."""

    def __init__(self, handle: StatefulProcessorHandle):
        key = T.StructType([T.StructField("block", T.LongType())])
        self.held = handle.getMapState("blocks", key, T.StructType([T.StructField("body", T.BinaryType())]))

    def write(self, number: int, body) -> None:
        self.held.updateValue((number,), (pickle.dumps(body, 5),))

    def take(self, number: int):
        body = pickle.loads(bytes(self.held.getValue((number,))[0]))
        self.held.removeKey((number,))
        return body


class OrderedProcessor(StatefulProcessor):
    """Hands rows on once, in time order, when the watermark has passed them.

    ``step(memory, rows, closed, blocks)`` gets what the key remembers, its newly final rows and the time up to which rows
    are final; it returns (rows to emit, new memory or None, time at which it must run again or None).
    """

    def __init__(self, columns: Sequence[str], work, out: Sequence[str]):
        self.columns, self.work, self.out = list(columns), work, list(out)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", T.StructType([T.StructField("body", T.BinaryType())]))
        self.memory = handle.getValueState("memory", T.StructType([T.StructField("body", T.BinaryType())]))
        self.blocks = Blocks(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            # What a row of another bucket leaves behind may be less than the row itself.
            kept = self.work.arriving(self, batch)
            if len(kept):
                self.rows.appendValue((pickle.dumps(kept[self.columns], 5),))
                self.wake(int(kept[US].min()))
        return iter(())

    def wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def remembered(self):
        return pickle.loads(bytes(self.memory.get()[0])) if self.memory.exists() else None

    def remember(self, memory) -> None:
        if memory is None:
            self.memory.clear()
        else:
            self.memory.update((pickle.dumps(memory, 5),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() * 1000
        bodies = [pickle.loads(bytes(r[0])) for r in self.rows.get()] if self.rows.exists() else []
        held = pd.concat(bodies, ignore_index=True) if bodies else pd.DataFrame(columns=self.columns)
        final = held[US] <= closed
        done = held[final].sort_values(US, kind="stable").reset_index(drop=True)
        if len(done):
            if final.all():
                self.rows.clear()
            else:
                self.rows.put([(pickle.dumps(held[~final], 5),)])
        if (~final).any():
            self.wake(int(held.loc[~final, US].min()))
        emitted, memory, again = self.work.step(self.remembered(), done, closed, self.blocks)
        self.remember(memory)
        if again is not None:
            self.wake(int(again))
        if len(emitted):
            yield emitted[self.out].reset_index(drop=True)

    def close(self) -> None:
        pass


def keyed(
    stream: DataFrame, entity: str, time: str, width: int | None, before: int, after: int, delay: str,
    halo_filter=None,
) -> DataFrame:
    """Watermarked stream with bucket, ownership and halo copies (only those passing ``halo_filter``).

    Without a ``width`` all rows of an entity share one bucket.
    """
    marked = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    placed = lay.range_halo(marked.withColumn(US, scalars.micros(time)), F.col(US), lay.Layout(width), before, after)
    placed = placed.withColumnsRenamed({lay.OWN: OWN, lay.BUCKET: BUCKET})
    return placed if halo_filter is None else placed.where(F.col(OWN) | halo_filter)


def run(
    placed: DataFrame, entity: str, time: str, value_columns: Sequence[str], work, outputs: Sequence[T.StructField],
    grouped: bool = False,
) -> DataFrame:
    """``grouped`` hands ``work`` many entities at once; rows without an entity are a group of their own."""
    columns = [*value_columns, US, OWN]
    emitted = T.StructType([*[placed.schema[c] for c in value_columns], *outputs])
    processor = partial(OrderedProcessor, columns, work, [f.name for f in emitted.fields])()
    key = entity
    if grouped:
        group = F.when(F.col(entity).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(entity), F.lit(GROUPS)))
        placed, key = placed.withColumn(GROUP, group.cast("int")), GROUP
    needed = placed.select(BUCKET, *dict.fromkeys([key, entity, time, *columns]))
    return needed.groupBy(key, BUCKET).transformWithStateInPandas(
        processor, emitted, "Append", "EventTime"
    )


def points(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of every distinct time, number of the distinct time of every row) of sorted times."""
    new = np.append(True, times[1:] != times[:-1]) if len(times) else np.zeros(0, bool)
    return np.flatnonzero(new), np.cumsum(new) - 1
