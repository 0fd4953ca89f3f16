"""Removal of repeated passages by suffix arrays.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts anywhere else.

1. Every start of such a string is named by its anchor: of the ``ANCHOR``-byte strings inside it the one with the
   smallest hash, the leftmost on ties. Equal strings have equal anchors at equal places, and neighbouring starts mostly
   share theirs, so a text becomes runs of starts, each with the bytes that its strings cover: its context.
2. An anchor that occurs once cannot lie in a repeated string. For the others, equal contexts are counted by a digest of
   their bytes: a context that occurs twice is repeated at all its starts, wherever it occurs. Sums of bytes times powers
   modulo 2^64 name anchors only; texts can be made whose sums agree for every base, which there costs time alone.
3. Where an anchor has several different contexts, one of each is fetched. Contexts are cut into cells of ``CELL`` bytes
   counted from the anchor; a suffix array over the cells, built by linear grouping, brings equal stretches of cells
   together, and the bytes left over at both ends are compared exactly.
4. The starts found are spans of their documents; whatever they cover goes.

Defined results. Null and empty texts, and texts below ``LENGTH`` bytes, lose nothing. Matches never cross documents.
Repeated rows and equal texts remove each other entirely. Texts are judged as UTF-8 bytes; a cut may fall inside a
character, so the remaining text drops what is no longer a whole character while the digest covers all remaining bytes.
Other columns are ignored or kept as they are.

Scale. Runs are about one narrow row per 140 bytes. Counts combine map-side, joins meet checkpointed tables so that
Spark can split skewed keys, and an anchor with more than ``BLOCK_CONTEXTS`` different contexts leaves the suffix arrays:
its strings are counted by 128-bit digest and place, which needs no group in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwise.llm.common import cut
from tabwise.llm.hashing import INVERSE, PIECE, mix, powers, prefix_sums
from tabwise.llm.suffix_array import suffix_array

LENGTH = 400
ANCHOR = 128
CELL = 16
#: Whole cells that lie in every string, wherever it starts.
CELLS = LENGTH // CELL - 1
#: Different contexts of one anchor that one task sorts.
BLOCK_CONTEXTS = 2000
#: Symbols that are sorted together.
BLOCK_SYMBOLS = 60_000


def digests(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """BLAKE2b of the byte strings between ``begins`` and ``ends``, as rows of ``size`` numbers of 64 bits."""
    view = memoryview(data)
    joined = b"".join([hashlib.blake2b(view[a:b], digest_size=8 * size).digest()
                       for a, b in zip(begins.tolist(), ends.tolist())])
    return np.frombuffer(joined, "<i8").reshape(-1, size)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, by smallest values from both ends of blocks."""
    count = len(x) - width + 1
    filled = np.concatenate((x, np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    forward = np.minimum.accumulate(filled, 1).ravel()
    backward = np.minimum.accumulate(filled[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(backward[:count], forward[width - 1:width - 1 + count])


def runs_of(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, first start, starts, anchor place, anchor hash, context digest) of all runs of texts in one array."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none, none
    sums, back = prefix_sums(data), powers(INVERSE, n + 1)
    anchors = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * back[:n - ANCHOR + 1])
    ranked = anchors & np.uint64(0xFFFFFFFF00000000) | np.arange(len(anchors), dtype=np.uint64)
    chosen = (sliding_least(ranked, LENGTH - ANCHOR + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    starts = np.flatnonzero(text[:n - LENGTH + 1] == text[LENGTH - 1:])
    if not len(starts):
        return none, none, none, none, none, none
    breaks = np.flatnonzero((np.diff(starts) != 1) | (np.diff(chosen[starts]) != 0)) + 1
    first = starts[np.concatenate(([0], breaks))]
    last = starts[np.concatenate((breaks - 1, [len(starts) - 1]))]
    context = digests(data, first, last + LENGTH, 1)[:, 0]
    place = chosen[first]
    return (text[first], first - edges[text[first]], last - first + 1, place - first, anchors[place].view(np.int64),
            context)


def _pieces(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, edges, text numbers, offsets) of parts of at most about ``PIECE`` bytes.

    A longer text comes in parts that overlap by one string less a byte, so every start lies in one part.
    """
    parts, numbers, offsets, size = [], [], [], 0
    for k, raw in enumerate(raws):
        for at in range(0, max(1, len(raw) - LENGTH + 1), PIECE - LENGTH):
            part = raw[at:at + PIECE - 1]
            if parts and size + len(part) > PIECE:
                yield _joined(parts, numbers, offsets)
                parts, numbers, offsets, size = [], [], [], 0
            parts.append(part)
            numbers.append(k)
            offsets.append(at)
            size += len(part)
    if parts:
        yield _joined(parts, numbers, offsets)


def _joined(parts, numbers, offsets):
    edges = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return np.frombuffer(b"".join(parts), np.uint8), edges, np.array(numbers), np.array(offsets)


def text_runs(docs: DataFrame) -> DataFrame:
    """g (anchor), c (context), doc_id, text_hash, start and starts of every run."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [t.as_py().encode("utf-8", "surrogatepass") for t in batch.column(2)]
            for data, edges, numbers, offsets in _pieces(raws):
                text, first, starts, _, g, c = runs_of(data, edges)
                row = pa.array(numbers[text])
                yield pa.record_batch(
                    [pa.array(g), pa.array(c), batch.column(0).take(row), batch.column(1).take(row),
                     pa.array(first + offsets[text]), pa.array(starts.astype(np.int32))],
                    ["g", "c", "doc_id", "text_hash", "start", "starts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _keyed(docs).mapInArrow(find, f"g long, c long, doc_id {kind}, text_hash long, start long, starts int")


def _keyed(docs: DataFrame) -> DataFrame:
    """The texts that can lose something."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where(
        F.octet_length("text") >= LENGTH)


def _same_doc(left: DataFrame, right: DataFrame):
    return left["doc_id"].eqNullSafe(right["d"]) & (left["text_hash"] == right["h"])


class Contexts:
    """Contexts of some anchors: their bytes side by side, where each begins, and where its anchor lies."""

    def __init__(self, raws: list[bytes], anchors: list[int]):
        self.data = np.frombuffer(b"".join(raws) + bytes(LENGTH + CELL), np.uint8)
        self.ends = np.cumsum([len(r) for r in raws])
        self.begins = self.ends - np.array([len(r) for r in raws])
        self.anchors = np.array(anchors)

    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, context, place): the whole cells of all contexts in order, a symbol of its own after each context."""
        shift = self.anchors % CELL
        counts = (self.ends - self.begins - shift) // CELL
        context = np.repeat(np.arange(len(counts)), counts + 1)
        inside = np.arange(len(context)) - np.repeat(np.cumsum(counts + 1) - counts - 1, counts + 1)
        place = self.begins[context] + shift[context] + inside * CELL
        closing = inside == counts[context]
        cells = np.lib.stride_tricks.sliding_window_view(self.data, CELL)[place[~closing]]
        _, names = np.unique(np.ascontiguousarray(cells).view(f"V{CELL}").ravel(), return_inverse=True)
        symbols = np.empty(len(context), np.int64)
        symbols[closing] = context[closing]
        symbols[~closing] = names + len(counts)
        return symbols, context, place


def repeated_starts(contexts: Contexts) -> list[np.ndarray]:
    """For each context its starts whose string occurs at another start of these contexts."""
    symbols, context, place = contexts.cells()
    order = suffix_array(symbols)
    usable = np.zeros(len(symbols), bool)
    if len(symbols) >= CELLS:
        inner = context[:len(symbols) - CELLS + 1]
        closing = np.concatenate((context[1:] != context[:-1], [True]))
        no_end = np.concatenate(([0], np.cumsum(closing)))
        usable[:len(inner)] = no_end[CELLS:] == no_end[:len(no_end) - CELLS]
    order = order[usable[order]]
    if not len(order):
        return [np.zeros(0, np.int64) for _ in contexts.begins]
    same = np.ones(len(order) - 1, bool)
    for k in range(CELLS):
        same &= symbols[order[1:] + k] == symbols[order[:-1] + k]
    stretch = np.concatenate(([0], np.cumsum(~same)))  # suffixes that share all cells of a string
    shared = np.bincount(stretch)[stretch] > 1
    at, stretch = place[order[shared]], stretch[shared]
    owner = context[order[shared]]
    found = []
    # A string starts ``back`` bytes before its first whole cell and ends so many fewer after its last.
    ahead = np.lib.stride_tricks.sliding_window_view(contexts.data, CELL)[at + CELLS * CELL]
    padded = np.concatenate((np.zeros(CELL, np.uint8), contexts.data))
    behind = np.lib.stride_tricks.sliding_window_view(padded, CELL)[at]
    for back in range(CELL):
        fits = (at - back >= contexts.begins[owner]) & (at - back + LENGTH <= contexts.ends[owner])
        rest = np.concatenate((behind[fits][:, CELL - back:], ahead[fits][:, :CELL - back]), axis=1)
        halves = np.ascontiguousarray(rest).view(np.uint64)
        group = np.lexsort((halves[:, 1], halves[:, 0], stretch[fits]))
        keys = [stretch[fits][group], halves[group, 0], halves[group, 1]]
        new = np.ones(len(group) + 1, bool)
        if len(group):
            new[1:-1] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        twice = ~(new[:-1] & new[1:]) if len(group) else np.zeros(0, bool)
        hit = np.flatnonzero(fits)[group[twice]]
        found.append(np.stack((owner[hit], at[hit] - back - contexts.begins[owner[hit]]), axis=1))
    pairs = np.concatenate(found)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return np.split(pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(1, len(contexts.begins))))


def _spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive numbers, ends exclusive."""
    edges = np.flatnonzero(np.diff(starts) != 1) + 1
    return [(int(p[0]), int(p[-1]) + 1) for p in np.split(starts, edges) if len(p)]


FOUND = "d {kind}, h long, begin long, end long"


def _sort_contexts(kind: str):
    """Arrow function over rows (g, raw, anchor, doc_id, text_hash, start) sorted by g: the repeated starts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows):
            out = []
            for row, starts in zip(rows, repeated_starts(Contexts([r[1] for r in rows], [r[2] for r in rows]))):
                out += [(row[3], row[4], row[5] + a, row[5] + b) for a, b in _spans(starts)]
            columns = list(zip(*out)) if out else [(), (), (), ()]
            types = (id_type, pa.int64(), pa.int64(), pa.int64())
            return pa.record_batch([pa.array(x, t) for x, t in zip(columns, types)], ["d", "h", "begin", "end"])

        id_type, rows, symbols, last = None, [], 0, None
        for batch in batches:
            id_type = batch.schema.field(3).type
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if symbols > BLOCK_SYMBOLS and row[0] != last:
                    yield solve(rows)
                    rows, symbols = [], 0
                rows.append(row)
                last = row[0]
                symbols += len(row[1]) // CELL + 1
        if rows:
            yield solve(rows)
    return run


def _fetch(large: bool, kind: str):
    """Arrow function over texts joined with the contexts wanted of them (g, start, starts).

    Emits each context's bytes, or, for anchors with very many contexts, one row per string.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                raw = batch.column(2)[k].as_py().encode("utf-8", "surrogatepass")
                wanted = batch.column(3)[k].as_py()
                rows = []
                for w in wanted:
                    part = raw[w["start"]:w["start"] + w["starts"] + LENGTH - 1]
                    data = np.frombuffer(part, np.uint8)
                    if large:
                        first = np.arange(w["starts"])
                        named = digests(data, first, first + LENGTH, 2).tolist()
                        rows += [(w["g"], one, two, w["start"] + i) for i, (one, two) in enumerate(named)]
                    else:
                        _, _, _, anchor, _, _ = runs_of(data, np.array([0, len(data)]))
                        rows.append((w["g"], part, int(anchor[0]), w["start"]))
                names = ["g", "one", "two", "start"] if large else ["g", "raw", "anchor", "start"]
                kinds = [pa.int64(), pa.int64() if large else pa.binary(), pa.int64(), pa.int64()]
                columns = [pa.array(x, t) for x, t in zip(zip(*rows), kinds)]
                same = pa.array(np.zeros(len(rows), np.int32))
                yield pa.record_batch([*columns, batch.column(0).slice(k, 1).take(same),
                                       batch.column(1).slice(k, 1).take(same)], [*names, "d", "h"])

    shape = "g long, one long, two long, start long" if large else "g long, raw binary, anchor long, start long"
    return run, f"{shape}, d {kind}, h long"


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(d, h, begin, end): runs of starts of repeated strings in the document with id d and text hash h."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    runs = text_runs(docs)
    repeated = cut(runs.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("g"))
    kept = cut(runs.join(repeated, "g", "left_semi"))
    contexts = kept.groupBy("g", "c").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_hash", "start", "starts")).alias("first"))
    contexts = cut(contexts)
    # The same contexts everywhere: repeated at every start.
    often = contexts.where("n > 1").select("g", "c")
    full = kept.join(often, ["g", "c"], "left_semi").select(
        F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("start").alias("begin"),
        (F.col("start") + F.col("starts")).alias("end"))
    several = cut(contexts.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    unlike = contexts.join(several, "g").select("g", "m", "n", "first.*")
    wanted = cut(unlike)
    found = full
    for large in (False, True):
        size = F.col("m") > BLOCK_CONTEXTS
        mine = wanted.where(size if large else ~size)
        if mine.isEmpty():
            continue
        by_doc = mine.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(
            F.collect_list(F.struct("g", "start", "starts")).alias("wanted"))
        texts = _keyed(docs)
        joined = texts.join(by_doc.hint("shuffle_hash"), _same_doc(texts, by_doc)).select(
            "doc_id", "text_hash", "text", "wanted")
        fetched = joined.mapInArrow(*_fetch(large, kind))
        if large:
            strings = fetched.groupBy("g", "one", "two")
            twice = strings.agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g", "one", "two")
            starts = cut(fetched).join(cut(twice), ["g", "one", "two"], "left_semi").select(
                "d", "h", F.col("start").alias("begin"), (F.col("start") + 1).alias("end"))
            found = found.unionByName(starts)
        else:
            # Rows of one text that occur twice in the table are fetched twice, but are one context.
            once = fetched.repartition("g").sortWithinPartitions("g", "h", "d", "start")
            found = found.unionByName(once.select("g", "raw", "anchor", "d", "h", "start").mapInArrow(
                _sort_contexts(kind), FOUND.format(kind=kind)))
    return found


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte runs covered by the strings at the given runs of starts; overlapping and touching ones merge."""
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        stop = end + LENGTH - 1
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([begin, stop])
    return [(a, b) for a, b in out]


def without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in runs:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def removals(docs: DataFrame) -> DataFrame:
    """(d, h, spans) of every document that loses something; spans are runs of repeated starts."""
    return repeated_spans(docs).groupBy("d", "h").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """What each document loses, and the digest of what is left."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                runs = covered([(s["begin"], s["end"]) for s in spans.as_py() or []])
                rows.append((len(raw), sum(b - a for a, b in runs), len(runs),
                             hashlib.sha256(without(raw, runs)).hexdigest()))
            columns = list(zip(*rows)) if rows else [(), (), (), ()]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.record_batch([batch.column(0), *[pa.array(x, t) for x, t in zip(columns, types)]],
                                  ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(docs).mapInArrow(
        digest, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def with_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text and spans (null where nothing goes) of every document."""
    gone = removals(docs)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return texts.join(gone.hint("shuffle_hash"), _same_doc(texts, gone), "left").select("doc_id", "text", "spans")
