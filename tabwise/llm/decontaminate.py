"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items.

Every window of consecutive item words is one pattern. A text is scanned once, whole, in its normalised form; matches
come back as word positions and as offsets into the original text. Text and patterns are compared as UTF-8 bytes, where
lower-casing A-Z and blanking other ASCII separators keep every offset in place.

Defined results. Null and empty texts have no words and no hits. Items without words match nothing; repeated items
count once per ``item_id``; a null ``item_id`` counts as the empty string. Repeated documents each keep their row. An
empty benchmark leaves every document clean. Other columns are ignored, whatever their names.

Scale. Documents are never shuffled. The automaton is broadcast only up to ``BLOCK_CHARS`` of patterns; a larger
benchmark is split by hash into blocks of that size, which the texts pass through one after the other, so no task or
driver holds more than one block's patterns.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 10
# Pattern characters (item names included) that one broadcast automaton may hold.
BLOCK_CHARS = 4_000_000

# Lower-cases A-Z and turns every other ASCII character that is no word character into a space.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split() if text else []


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct (window, item): runs of ``width`` words; a shorter item is one window."""
    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows, items = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(text)
                if w:
                    own = {b" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))}
                    windows.extend(own)
                    items.extend([item] * len(own))
            yield pa.record_batch([pa.array(windows, pa.binary()), pa.array(items, pa.string())], ["window", "item"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return rows.mapInArrow(cut_windows, "window binary, item string").distinct()


def build_automaton(patterns: dict[bytes, list[str]]):
    """Patterns stand between spaces, so that only whole words match; bytes are taken as Latin-1 characters."""
    automaton = ahocorasick.Automaton()
    for window, items in patterns.items():
        automaton.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, items))
    if patterns:
        automaton.make_automaton()
    return automaton


def find_hits(automaton, normal: list[bytes]) -> tuple[np.ndarray, set[str]]:
    """(mask of hit words, items found) of one text given as its words."""
    mask, items = np.zeros(len(normal), bool), set()
    if not normal or not len(automaton):
        return mask, items
    line = f" {b' '.join(normal).decode('latin-1')} "
    blanks, change = None, None
    for end, (length, found) in automaton.iter(line):
        if blanks is None:
            blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
            change = np.zeros(len(normal) + 1, np.int64)
        last = int(np.searchsorted(blanks, end))  # the blank after word last - 1
        change[last - length] += 1
        change[last] -= 1
        items.update(found)
    if change is not None:
        mask = np.cumsum(change[:-1]) > 0
    return mask, items


def original_spans(text: str, mask: np.ndarray) -> list[tuple[int, int]]:
    """Code point spans (end exclusive) of the runs of hit words."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(NORMAL), np.uint8)
    inside = np.concatenate(([False], raw != 32, [False]))
    starts, ends = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return [(int(points[starts[a]]), int(points[ends[b - 1]])) for a, b in zip(edge[::2], edge[1::2])]


SCANNED = "n_words long, hit array<int>, items array<string>, spans array<struct<start:long,end:long>>"


def _scanner(pairs, places: int, first: bool):
    """Arrow function that adds one block's hits. Rows: kept columns, text, and from the second block on the finds."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns: dict[bytes, list[str]] = {}
        for window, item in pairs.value:
            patterns.setdefault(bytes(window), []).append(item)
        automaton = build_automaton(patterns)
        for batch in batches:
            texts = batch.column(places)
            earlier = None if first else (batch.column(places + 2).to_pylist(), batch.column(places + 3).to_pylist())
            counts, hits, found, spans = [], [], [], []
            for k, value in enumerate(texts):
                text = value.as_py()
                normal = words(text)
                mask, items = find_hits(automaton, normal)
                if earlier:
                    mask[earlier[0][k]] = True
                    items.update(earlier[1][k])
                counts.append(len(normal))
                hits.append(np.flatnonzero(mask).astype(np.int32))
                found.append(sorted(items))
                spans.append([{"start": a, "end": b} for a, b in original_spans(text, mask)] if mask.any() else [])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            names = batch.schema.names[:places + 1]
            yield pa.record_batch(
                [*batch.columns[:places + 1], pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int32())),
                 pa.array(found, pa.list_(pa.string())), pa.array(spans, kind)],
                [*names, "n_words", "hit", "items", "spans"])
    return scan


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], width: int = WIDTH,
         block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``keep`` columns, text, n_words, hit (word positions), items and spans of every document."""
    spark = docs.sparkSession
    pairs = item_windows(benchmark, width).persist()
    chars = pairs.agg(F.sum(F.length("window") + F.length("item") + 2)).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    which = F.pmod(F.xxhash64("window", "item"), F.lit(blocks))
    given = docs.select(*keep, "text")
    kept_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields)
    out = given
    for k in range(blocks):
        sent = spark.sparkContext.broadcast([(r[0], r[1]) for r in pairs.where(which == k).collect()])
        out = out.mapInArrow(_scanner(sent, len(keep), k == 0), f"{kept_types}, {SCANNED}")
    pairs.unpersist()
    return out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest per document: how many words and items are hit, and which."""
    items = F.array_sort("items")
    return scan(docs, benchmark, ["doc_id"]).select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"),
        "spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without any hit word, all their columns unchanged."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    others = [n for n, c in zip(names, docs.columns) if c != "text"]
    given = docs.toDF(*names).withColumnRenamed(names[docs.columns.index("text")], "text")
    clean = scan(given, benchmark, others).where(F.size("hit") == 0)
    return clean.select(*[
        F.col("text" if c == "text" else n).alias(c) for n, c in zip(names, docs.columns)])

