"""Token ids in binary files with Elias-Fano document boundaries.

A file holds the ids of consecutive documents as one array, the end of each document as an Elias-Fano sequence, and the
document ids as another. A sequence of n values below u takes about 2 + log2(u / n) bits per value: the lower bits are
packed, the upper bits are stored in unary, and sampled counts let ``select`` find any offset without a table of 64-bit
numbers.

Defined results. Null and empty texts have no ids of their own, only the end id. Documents lie in ascending doc_id, null
first; equal ids are ordered by the checksum of their text, and rows equal in both are interchangeable. An empty table
gives no file and no rows. Other columns are ignored.

Scale. One range partitioning puts texts in order; tokenising follows it, so no id is shuffled. A file is closed at
``FILE_IDS`` ids, which bounds a task's memory by one file's array and one Arrow batch. Files appear by an atomic move.
Global offsets are sums over files, per task first. Words repeat, so each worker remembers the ids of up to
``REMEMBERED`` words of up to ``LONGEST`` bytes, the first that come; what stands between ASCII white space is encoded on its own, which gives the same ids for
tokenizers that drop white space and never join across it. New words are mostly old pieces with other marks around them:
of a tokenizer with the ``STEPS`` below, words of plain characters are parted into the pieces that these steps make, and
only pieces that are not among ``REMEMBERED_PIECES`` go through its model. Workers outlive their tasks and stand idle beside
the stages that follow, so these memories are small, and what a task has freed goes back to the system.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, count, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwise.llm.common import atomic_output, cut, give_back, new_folder, open_filesystem, partitions

MAGIC = b"TOKSEF01"
END_ID = 2
FILE_IDS = 8_000_000
REMEMBERED = 200_000
REMEMBERED_PIECES = 150_000
LONGEST = 64
#: Bytes of texts that are encoded together, besides the last text.
TEXT_BYTES = 4_000_000
#: Ones between two sampled positions of the upper bits.
SAMPLE = 256


class EliasFano:
    """Non-decreasing numbers from 0, compressed; ``select(i)`` is the i-th."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        counts = np.cumsum(np.bitwise_count(high), dtype=np.int64)
        #: Byte of the upper bits that holds every ``SAMPLE``-th one, and the ones before it.
        self.sample = np.searchsorted(counts, np.arange(0, n, SAMPLE), "right")
        self.before = counts[self.sample] - np.bitwise_count(high[self.sample]) if n else counts

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        low_bits = max(0, ((int(values[-1]) + 1) // n).bit_length() - 1)
        lows = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1, np.uint8)
        bits[places] = 1
        return cls(n, low_bits, np.packbits(lows.astype(np.uint8), bitorder="little"), np.packbits(bits, bitorder="little"))

    def _low(self, i: int) -> int:
        first, last = i * self.low_bits, (i + 1) * self.low_bits
        if first == last:
            return 0
        window = int.from_bytes(self.low[first // 8:-(-last // 8)].tobytes(), "little")
        return (window >> first % 8) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        byte, ones = int(self.sample[i // SAMPLE]), int(self.before[i // SAMPLE])
        while ones + (here := int(self.high[byte]).bit_count()) <= i:
            byte, ones = byte + 1, ones + here
        bits = int(self.high[byte])
        for _ in range(i - ones):
            bits &= bits - 1
        place = 8 * byte + (bits & -bits).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n].astype(np.uint64)
        out = (places - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low_bits)
        if self.low_bits and self.n:
            lows = np.unpackbits(self.low, bitorder="little")[:self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= (lows.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + \
            self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple[EliasFano, memoryview]:
        n, low_bits, a, b = struct.unpack_from("<QBQQ", data)
        head = struct.calcsize("<QBQQ")
        low, high = np.frombuffer(data[head:head + a], np.uint8), np.frombuffer(data[head + a:head + a + b], np.uint8)
        return cls(n, low_bits, low, high), data[head + a + b:]


def pack_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """Fields in order: magic, count of null doc_ids, smallest doc_id, id width, boundaries, doc_ids, ids."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    named = EliasFano.encode(known.astype(np.uint64) - np.uint64(least & (1 << 64) - 1))
    return (MAGIC + struct.pack("<QqB", len(doc_ids) - len(known), least, width)
            + EliasFano.encode(np.cumsum(lengths, dtype=np.int64)).to_bytes() + named.to_bytes()
            + ids.astype(f"<u{width}").tobytes())


def unpack_file(data: bytes) -> tuple[list[int | None], EliasFano, np.ndarray]:
    """(doc_ids, ends of the documents, all ids)."""
    if data[:8] != MAGIC:
        raise ValueError("not a file of token ids")
    nulls, least, width = struct.unpack_from("<QqB", data, 8)
    ends, rest = EliasFano.from_bytes(memoryview(data)[8 + struct.calcsize("<QqB"):])
    named, rest = EliasFano.from_bytes(rest)
    known = (named.all() + np.uint64(least & (1 << 64) - 1)).astype(np.int64)
    return [None] * nulls + known.tolist(), ends, np.frombuffer(rest, f"<u{width}")


#: Words that the tokenizer gets as one text.
LOT = 256
#: Steps of a tokenizer whose words can be parted into pieces here, so that only unknown pieces are merged.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
#: Characters before this one are composed and have one character as lower case, except U+0130.
PLAIN = 0x180


def _of_category(first: str) -> str:
    return "".join(re.escape(c) for c in map(chr, range(PLAIN)) if unicodedata.category(c)[0] == first)


#: The pieces of plain words in lower case, and the line feeds between the words.
PIECES = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[{0}]+|[{1}]|[^\\t-\\r \x85\xa0{0}{1}]+".format(
    _of_category("L"), _of_category("N")))


def gather(ids: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the given entries one after the other, and how many each has; entry k is ``ids[ends[k]:ends[k + 1]]``."""
    first = ends[numbers]
    counts = ends[numbers + 1] - first
    stops = np.cumsum(counts)
    return ids[np.repeat(first - stops + counts, counts) + np.arange(stops[-1] if len(stops) else 0)], counts


class Remembered:
    """Ids of up to ``most`` strings no longer than ``LONGEST``; ``look_up`` gives those of others, as one array and the count of each."""

    def __init__(self, look_up: Callable[[list], tuple[np.ndarray, np.ndarray]], most: int):
        self.look_up, self.most = look_up, most
        self.numbers, self.ids, self.ends = {}, np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def __call__(self, strings: list, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``gather`` of ``strings[k]`` for every k of ``at``; the strings are distinct."""
        get, known = self.numbers.get, len(self.numbers)
        numbers = np.fromiter(map(get, strings, repeat(-1)), np.int64, len(strings))
        places = np.flatnonzero(numbers < 0)
        ids, ends = self.ids, self.ends
        if len(places):
            unknown = [strings[k] for k in places]
            more, counts = self.look_up(unknown)
            ids, ends = np.concatenate((ids, more)), np.concatenate((ends, ends[-1] + np.cumsum(counts)))
            numbers[places] = known + np.arange(len(places))
            # What came first is most frequent; the rest is looked up again where it occurs.
            sizes = np.fromiter(map(len, unknown), np.int64, len(unknown))
            kept = np.flatnonzero(sizes <= LONGEST)[:self.most - known]
            if len(kept):
                self.numbers.update(zip(map(unknown.__getitem__, kept.tolist()), count(known)))
                own, own_counts = gather(more, np.concatenate(([0], np.cumsum(counts))), kept)
                self.ids = np.concatenate((self.ids, own))
                self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(own_counts)))
        return gather(ids, ends, numbers[at])


class Encoder:
    """Ids of texts, remembering those of the words and of the pieces of words seen before."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(Path(path).read_text("utf-8"))
        self.model, byte_level = self.tokenizer.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(PLAIN) if chr(c) != "\n"}
        self.in_pieces = all(spec.get(k) == v for k, v in STEPS.items()) and spec["model"]["type"] == "BPE" \
            and not any(t["normalized"] for t in spec["added_tokens"])
        # In UTF-8: characters from PLAIN on begin with a byte from C6 on, and C4 B0 is U+0130.
        added = [re.escape(t["content"].encode()) for t in spec["added_tokens"]]
        self.whole = re.compile(b"|".join([b"[\xc6-\xff]", b"\xc4\xb0", *added]))
        self.words, self.pieces = Remembered(self._words, REMEMBERED), Remembered(self._pieces, REMEMBERED_PIECES)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = [[t.id for t in self.model.tokenize(p)] for p in "\n".join(pieces).translate(self.bytes).split("\n")]
        return np.fromiter(chain.from_iterable(codes), "<u4"), np.fromiter(map(len, codes), np.int64, len(codes))

    def _in_pieces(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts = PIECES.findall(b"\n".join([b"", *words]).decode().lower())  # a line feed before every word, numbered 0
        order = defaultdict(count().__next__)
        at = np.fromiter(map(order.__getitem__, parts), np.int64, len(parts))
        inner = at > 0
        ids, counts = self.pieces(list(order)[1:], at[inner] - 1)
        filled = np.zeros(len(at), np.int64)
        filled[inner] = counts
        return ids, np.add.reduceat(filled, np.flatnonzero(~inner)) if len(words) else filled

    def _in_lots(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words encoded in lots of one text each, which white space parts; offsets tell whose an id is."""
        lots = [words[k:k + LOT] for k in range(0, len(words), LOT)]
        found, counts = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        codes = self.tokenizer.encode_batch([b"\n".join(x).decode() for x in lots], add_special_tokens=False)
        for lot, code in zip(lots, codes):
            ends = np.cumsum([len(w.decode()) + 1 for w in lot])
            found.append(np.array(code.ids, "<u4"))
            counts.append(np.diff(np.searchsorted([start for start, _ in code.offsets], ends), prepend=0))
        return np.concatenate(found), np.concatenate(counts)

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not self.in_pieces:
            return self._in_lots(words)
        whole = np.fromiter(map(bool, map(self.whole.search, words)), bool, len(words))
        plain, plain_counts = self._in_pieces([w for w, x in zip(words, whole.tolist()) if not x])
        if not whole.any():
            return plain, plain_counts
        rest, rest_counts = self._in_lots([words[k] for k in np.flatnonzero(whole)])
        place = np.argsort(np.concatenate((np.flatnonzero(~whole), np.flatnonzero(whole))))
        ends = np.concatenate(([0], np.cumsum(np.concatenate((plain_counts, rest_counts)))))
        return gather(np.concatenate((plain, rest)), ends, place)

    def __call__(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(column)
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()  # to_pylist is ten times slower
        ids, counts = self.words(distinct, words.indices.to_numpy().astype(np.int64))
        before = np.concatenate(([0], np.cumsum(counts)))
        per_text = pc.fill_null(pc.list_value_length(split), 0).to_numpy()
        return np.split(ids, before[np.cumsum(per_text)[:-1]]) if len(column) else []


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process, so that later tasks know the words of earlier ones."""
    return Encoder(path)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in order, parted after every ``TEXT_BYTES`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
    lots = (np.cumsum(sizes) - sizes) // TEXT_BYTES
    edges = [0, *(np.flatnonzero(np.diff(lots)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(edges, edges[1:]))


FILES = "task long, number long, path string, n_docs long, n_ids long"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the token files of all documents; returns their list, already written."""
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, task, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids, lengths, arrays, held = [], [], [], 0

        def close():
            name, ids = f"ids-{task:06d}-{number:05d}.tok", np.concatenate(arrays)
            with atomic_output(folder, name) as out:
                out.write(pack_file(doc_ids, lengths, ids))
            row = [[task], [number], [name], [len(doc_ids)], [len(ids)]]
            return pa.record_batch([pa.array(x) for x in row], ["task", "number", "path", "n_docs", "n_ids"])

        end = np.array([end_id], np.uint32)
        for doc_id, ids in (x for batch in batches for part in slices(batch) for x in zip(
                part.column(0).to_pylist(), encode(part.column(1)))):
            doc_ids.append(doc_id)
            lengths.append(len(ids) + 1)
            arrays += [ids, end]
            held += len(ids) + 1
            if held >= file_ids:
                yield close()
                doc_ids, lengths, arrays, held, number = [], [], [], 0, number + 1
        if doc_ids:
            yield close()

    def dump(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from written(batches)
        give_back()

    order = [F.col("doc_id").asc_nulls_first(), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))]
    # The last order column parts rows that are equal in all others.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("tie"))
    order.append(F.col("tie"))
    placed = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return cut(placed.mapInArrow(dump, FILES))


def with_offsets(files: DataFrame) -> DataFrame:
    """Add ``first``: ids in all files before. Sums run within a task's files; tasks, one row each, are added up."""
    own = Window.partitionBy("task").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = files.groupBy("task").agg(F.sum("n_ids").alias("ids"))
    before = tasks.select("task", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before"))
    inside = files.withColumn("inside", F.coalesce(F.sum("n_ids").over(own), F.lit(0)))
    return inside.join(before, "task").withColumn("first", F.col("before") + F.col("inside"))


def read(folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_filesystem(folder)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_stream(f"{base}/{name}", compression=None) as raw:
                    doc_ids, ends, ids = unpack_file(raw.read())
                wide = ids.astype("<u4")
                stops = [ends.select(i) for i in range(ends.n)]
                starts = [0, *stops[:-1]]
                yield pa.record_batch(
                    [pa.array(doc_ids, pa.int64()), pa.array([first + s for s in starts], pa.int64()),
                     pa.array([b - a for a, b in zip(starts, stops)], pa.int64()),
                     pa.array([zlib.crc32(wide[a:b]) for a, b in zip(starts, stops)], pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])
                del raw, doc_ids, ends, ids, wide, stops, starts
        give_back()

    # A number that is asked for is kept, while small partitions without one would be merged into a single task.
    named = with_offsets(files).select("path", "first").repartition(max(1, files.count()), F.col("path"))
    return named.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents as token files and tell from the files where each lies and what it holds."""
    folder = new_folder(docs.sparkSession, "tokens")
    return read(folder, write(docs, folder, tokenizer))
