"""Tasks over many groups at once: whole groups are handed to array code in large tables, not one by one."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Rows handed over together; a larger group comes alone.
TABLE_ROWS = 200_000


def numbered(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Number of the group of every row, 0 onwards; rows of a group lie together."""
    changed = np.zeros(table.num_rows, bool)
    for key in keys:
        codes = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        changed[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(changed)


def by_group(df: DataFrame, keys: Sequence[str], task: Callable[[pa.Table, np.ndarray], pa.Table], schema: T.StructType | str,
             rows: int = TABLE_ROWS) -> DataFrame:
    """``task(table, group numbers)`` over tables of whole groups of ``keys``."""
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, limit = [], 0, rows
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < limit:
                continue
            table = pa.Table.from_batches(held)
            groups = numbered(table, keys)
            whole = int(np.searchsorted(groups, groups[-1]))  # the last group may go on
            if not whole:
                limit = 2 * count
                continue
            yield from task(table.slice(0, whole), groups[:whole]).to_batches()
            held, count, limit = table.slice(whole).to_batches(), table.num_rows - whole, rows
        if count:
            table = pa.Table.from_batches(held)
            yield from task(table, numbered(table, keys)).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def locate(group: np.ndarray, at: np.ndarray, asked_group: np.ndarray, asked_at: np.ndarray, side: str) -> np.ndarray:
    """``searchsorted`` inside groups: place of each asked value among the entries, which are sorted by (group, at)."""
    n = len(group)
    first = np.concatenate((np.full(n, side == "left"), np.full(len(asked_group), side != "left")))
    order = np.lexsort((first, np.concatenate((at, asked_at)), np.concatenate((group, asked_group))))
    entries = order < n
    found = np.empty(len(asked_group), np.int64)
    found[order[~entries] - n] = np.cumsum(entries)[~entries]
    return found
