"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text becomes the set of its word shingles, a key of the whole set, and a MinHash signature. Texts with equal
   sets are one class from here on.
2. Classes that agree in a whole band of the signature are candidates. The number of bands follows from the threshold
   and ``MISS``, the chance to miss a pair exactly at the threshold.
3. Signatures of candidates are compared in batches. With a uniform prior the posterior chance that the similarity
   reaches the threshold, after m agreements in n, is that of at most m successes in n + 1 trials at the threshold; a
   pair whose chance falls below ``PRUNE`` is dropped after the batch that shows it.
4. What survives spans clusters. Inside a cluster full sets decide: every pair that is not connected yet is compared
   exactly, so no link between different texts of a cluster is lost, and only links that connect are reported.

Defined results. Null texts and texts without words have no set, are linked with nothing, and are their own component.
Repeated rows are equal texts. A null doc_id takes part but names no component; a component of nothing else has a null
id. In ``report`` rows that share a doc_id share its fate; ``keep_one`` leaves one row of a component. An empty table gives no rows. Other columns are ignored or kept as they are.

Scale. Sets travel once, for members of clusters alone. A group (band or cluster) above ``BLOCK_ROWS`` or
``BLOCK_BYTES`` is not put into one task: all members are held against its first member, which connects a family of
near-copies in linear work, and only what stays apart is compared with the rest, in pairs of blocks. Steps that hold a
few rows for every large group or link run in as many tasks as these need.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwise.llm.common import cut, gathered
from tabwise.llm.components import components
from tabwise.llm.hashing import mix, shingles, word_hashes

ROWS = 4
MISS = 1e-5
BATCH = 16
PRUNE = 1e-6
BLOCK_ROWS = 1000
BLOCK_BYTES = 8_000_000
#: Large groups whose sizes are broadcast at most: rows of a few numbers, about a megabyte.
FEW_GROUPS = 10_000
#: Rows of an Arrow batch that are sketched together.
TEXTS = 256


def bands(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands such that a pair exactly at the threshold is missed with at most the given chance."""
    return math.ceil(math.log(miss) / math.log1p(-threshold ** rows))


def least_agreements(threshold: float, compared: int, prune: float = PRUNE) -> int:
    """Fewest agreements among ``compared`` that leave a posterior chance of ``prune`` for the threshold."""
    total, n = 0.0, compared + 1
    for m in range(compared + 1):
        total += math.comb(n, m) * threshold ** m * (1 - threshold) ** (n - m)
        if total >= prune:
            return m
    return compared


def signature(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Smallest upper halves of the products with every factor."""
    best = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(values), 1024):
        products = values[a:a + 1024, None] * factors[None, :]
        np.minimum(best, (products.min(axis=0) >> np.uint64(32)).astype(np.uint32), out=best)
    return best


def set_key(values: np.ndarray) -> bytes:
    """128 bits of the set: two sums of independently mixed members."""
    first, second = mix(values), mix(values ^ np.uint64(0xD6E8FEB86659FD93))
    return np.array([first.sum(dtype=np.uint64), second.sum(dtype=np.uint64)], "<u8").tobytes()


def sketches(docs: DataFrame, width: int, hashes: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, key and sig of every document; key and sig are null without words."""
    factors = mix(np.arange(1, hashes + 1, dtype=np.uint64)) | np.uint64(1)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(start, TEXTS)
                sizes, keys, sigs = [], [], []
                for words in word_hashes(batch.column(2).to_pylist()):
                    values = shingles(words, width)
                    sizes.append(len(values))
                    keys.append(set_key(values) if len(values) else None)
                    sigs.append(signature(values, factors).tobytes() if len(values) else None)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()),
                                       pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                                      ["doc_id", "text_hash", "n_shingles", "key", "sig"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(sketch, f"doc_id {kind}, text_hash long, n_shingles long, key binary, sig binary")


class Forest:
    """Union-find over the members of one group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.top(i), self.top(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


class Signatures:
    """Compares signatures batch by batch."""

    def __init__(self, payloads: list[bytes], threshold: float):
        self.table = np.frombuffer(b"".join(payloads), np.uint32).reshape(len(payloads), -1)
        hashes = self.table.shape[1]
        self.stops = [(n, least_agreements(threshold, n)) for n in range(BATCH, hashes, BATCH)]
        self.stops.append((hashes, least_agreements(threshold, hashes)))

    def near(self, i: int, others: np.ndarray) -> Iterator[int]:
        """Members of ``others`` that no batch rules out."""
        agreed, done = np.zeros(len(others), np.int64), 0
        for n, least in self.stops:
            agreed += (self.table[others, done:n] == self.table[i, done:n]).sum(1)
            left = agreed >= least
            others, agreed, done = others[left], agreed[left], n
            if not len(others):
                return
        yield from others.tolist()


class Sets:
    """Compares full sets exactly."""

    def __init__(self, payloads: list[bytes], threshold: float):
        self.sets = [np.frombuffer(p, np.uint64) for p in payloads]
        self.sizes = np.array([len(s) for s in self.sets])
        self.hundredths = round(100 * threshold)

    def near(self, i: int, others: np.ndarray) -> Iterator[int]:
        small, large = np.minimum(self.sizes[others], self.sizes[i]), np.maximum(self.sizes[others], self.sizes[i])
        mine = self.sets[i]
        for j in others[100 * small >= self.hundredths * large].tolist():
            other = self.sets[j]
            place = np.searchsorted(mine, other)
            place[place == len(mine)] = 0
            both = int((mine[place] == other).sum())
            if 100 * both >= self.hundredths * (len(mine) + len(other) - both):
                yield j


def group_links(ids: list[bytes], sides: np.ndarray, compare) -> list[tuple[int, int]]:
    """Links that connect whatever is near; with two sides only pairs across them are compared."""
    n, forest, links = len(ids), Forest(len(ids)), []
    tops = np.arange(n)
    crossing = bool(sides.any())
    for i in range(1, n):
        while True:
            apart = tops[:i] != tops[i]
            if crossing:
                apart &= sides[:i] != sides[i]
            others = np.flatnonzero(apart)
            # One link to a component is enough: go on with the rest as soon as one is found.
            j = next(compare.near(i, others), None) if len(others) else None
            if j is None:
                break
            if ids[i] != ids[j]:
                links.append((i, j))
            forest.join(i, j)
            new = min(tops[i], tops[j])
            tops[(tops == tops[i]) | (tops == tops[j])] = new
    return links


def _group_task(compare: Callable, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows):
            ids, payloads, sides = [r[0] for r in rows], [r[1] for r in rows], np.array([r[2] for r in rows])
            return [(ids[i], ids[j]) for i, j in group_links(ids, sides, compare(payloads, threshold))]

        def out(links):
            return pa.record_batch([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], ["a", "b"])

        current, rows, links = None, [], []
        for batch in batches:
            columns = [batch.column(k) for k in range(5)]
            for k in range(batch.num_rows):
                name = columns[0][k].as_py(), columns[1][k].as_py()
                if name != current:
                    if len(rows) > 1:
                        links += solve(rows)
                    current, rows = name, []
                    if len(links) > 10_000:
                        yield out(links)
                        links = []
                rows.append((columns[2][k].as_py(), columns[3][k].as_py(), columns[4][k].as_py()))
        if len(rows) > 1:
            links += solve(rows)
        yield out(links)
    return run


def _leader_task(compare: Callable, threshold: float):
    """Adds ``linked``: whether the member is near the first of its group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for mine, first in zip(batch.column(2), batch.column(4)):
                pair = compare([first.as_py(), mine.as_py()], threshold)
                linked.append(next(pair.near(1, np.array([0])), None) is not None)
            yield pa.record_batch([*batch.columns[:4], pa.array(linked)], ["g", "id", "payload", "first", "linked"])
    return run


def connecting_links(members: DataFrame, compare: Callable, threshold: float, block_rows: int = BLOCK_ROWS,
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (a, b) that connect near members of each group; ``members`` has g, id (binary) and payload."""
    members = cut(members.select("g", "id", "payload"))
    group_type = members.schema["g"].dataType.simpleString()
    sizes = members.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("payload")).alias("bytes"), F.min("id").alias("first"))
    large = cut(sizes.withColumn("blocks", F.greatest(
        F.ceil(F.col("n") / block_rows), F.ceil(F.col("bytes") / block_bytes)).cast("long")).where("n > 1 AND blocks > 1"))
    groups, rows, size = large.agg(F.count(F.lit(1)), F.sum("n"), F.sum("bytes")).first()
    columns = ["g", "task", "id", "payload", "side"]

    def solve(tasks: DataFrame) -> DataFrame:
        dealt = tasks.repartition("g", "task").sortWithinPartitions("g", "task", "side", "id")
        return dealt.select(*columns).mapInArrow(_group_task(compare, threshold), "a binary, b binary")

    zero = F.lit(0).cast("long")
    if not groups:
        return solve(members.select("g", zero.alias("task"), "id", "payload", F.lit(0).alias("side")))

    def few(table: DataFrame) -> DataFrame:
        """One narrow row a large group: up to the bound they go to the members, so that payloads need not be shuffled."""
        return F.broadcast(table) if groups <= FEW_GROUPS else table

    large = cut(gathered(large, groups))
    small = members.join(few(large.select("g")), "g", "left_anti")
    links = solve(small.select("g", zero.alias("task"), "id", "payload", F.lit(0).alias("side")))
    # All members are read here, in tasks of their own; the large groups' rows then in as many as these need.
    heavy = gathered(cut(members.join(few(large.select("g", "first", "blocks")), "g")), rows, size)
    firsts = heavy.where("id = first").groupBy("g").agg(F.min("payload").alias("first_payload"))
    # The first of a group is at most as large as its group, so ``size`` bounds these.
    held = heavy.select("g", "id", "payload", "first").join(cut(gathered(firsts, groups, size)), "g").select(
        "g", "id", "payload", "first", "first_payload")
    judged = cut(gathered(held, rows, size).mapInArrow(
        _leader_task(compare, threshold), f"g {group_type}, id binary, payload binary, first binary, linked boolean"))
    links = links.unionByName(judged.where("linked AND id <> first").select(
        F.col("id").alias("a"), F.col("first").alias("b")))
    apart = judged.where("NOT linked")
    blocks = few(large.select("g", "blocks"))
    placed = judged.join(blocks, "g").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    # Blocks of what stays apart, each against every block of the group.
    mine = apart.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("payload")).alias("bytes")).select(
        "g", F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("bytes") / block_bytes)).cast("long").alias("own"))
    mine = few(cut(gathered(mine, groups)))
    left = apart.join(mine, "g").join(blocks, "g").select(
        "g", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("other"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.col("own")).alias("part"), "blocks", "id", "payload", F.lit(0).alias("side"))
    right = placed.join(mine, "g").select(
        "g", F.col("block").alias("other"), F.explode(F.sequence(zero, F.col("own") - 1)).alias("part"), "blocks", "id",
        "payload", F.lit(1).alias("side"))
    pairs = left.unionByName(right).withColumn("task", F.col("part") * F.col("blocks") + F.col("other"))
    return links.unionByName(solve(pairs))


def _full_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """g, id and payload (the sorted set) of every class in ``members`` (g, id, rep_id, rep_hash)."""
    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(start, TEXTS)
                sets = [shingles(w, width) for w in word_hashes(batch.column(2).to_pylist())]
                # Texts that merely share the representative's hash have another set.
                same = [set_key(s) == i.as_py() for s, i in zip(sets, batch.column(1))]
                out = pa.record_batch([batch.column(0), batch.column(1),
                                       pa.array([s.tobytes() for s in sets], pa.binary())], ["g", "id", "payload"])
                yield out.filter(pa.array(same))

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where("text IS NOT NULL")
    found = texts.join(members.hint("shuffle_hash"), texts["doc_id"].eqNullSafe(members["rep_id"])
                       & (texts["text_hash"] == members["rep_hash"]))
    return found.select("g", "id", "text").mapInArrow(load, "g binary, id binary, payload binary").dropDuplicates(["id"])


def component_table(docs: DataFrame, width: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n_shingles, key of every row; key, label, component_id of the keys that hold several rows)."""
    count = bands(threshold)
    rows = cut(sketches(docs, width, count * ROWS))
    classes = cut(rows.where("key IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("rep"),
        F.count(F.lit(1)).alias("n"), F.first("sig").alias("sig")))
    size = 4 * ROWS
    band_keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", b * size + 1, size)) for b in range(count)])
    banded = classes.select(F.explode(band_keys).alias("g"), F.col("key").alias("id"))
    repeated = banded.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g")
    candidates = banded.join(cut(repeated), "g", "left_semi")
    signed = cut(candidates).join(classes.select(F.col("key").alias("id"), F.col("sig").alias("payload")), "id")
    near = connecting_links(signed, Signatures, threshold)
    clusters = components(near)
    members = clusters.join(classes, F.col("node") == F.col("key")).select(
        F.col("label").alias("g"), F.col("key").alias("id"), F.col("rep.doc_id").alias("rep_id"),
        F.col("rep.text_hash").alias("rep_hash"))
    exact = connecting_links(_full_sets(docs, cut(members), width), Sets, threshold)
    linked = components(exact)
    named = classes.select("key", "least", "n").join(linked, F.col("key") == F.col("node"), "left").select(
        "key", "least", F.coalesce("label", "key").alias("label"), (F.col("label").isNotNull() | (F.col("n") > 1)).alias("several"))
    named = cut(named.where("several"))
    smallest = cut(named.groupBy("label").agg(F.min("least").alias("component_id")))
    return rows, cut(named.join(smallest, "label").select("key", "label", "component_id"))


def report(docs: DataFrame, width: int = 3, threshold: float = 0.85) -> DataFrame:
    """Set size, component and whether it is kept, for every document."""
    rows, several = component_table(docs.select("doc_id", "text"), width, threshold)
    found = rows.select("doc_id", "n_shingles", "key").join(several, "key", "left")
    component = F.when(F.col("component_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row of each group of near-duplicates, all its columns unchanged.

    It is the row of the smallest doc_id, then of the smallest text hash; documents without an id come last. Of rows
    equal in both, the one with the smallest hash over its columns stays. The documents to go are narrow; only they, and
    the few that stay but repeat, are joined to the texts.
    """
    names = [f"__c{i}" for i in range(len(docs.columns))]
    given = docs.toDF(*names).withColumnsRenamed({
        n: c for n, c in zip(names, docs.columns) if c in ("doc_id", "text")})
    rows, several = component_table(given.select("doc_id", "text"), width, threshold)
    members = cut(rows.join(several, "key").groupBy("label", "doc_id", "text_hash").agg(
        F.count(F.lit(1)).alias("n")).withColumn("place", F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")))
    firsts = members.groupBy("label").agg(F.min("place").alias("first"))
    marked = cut(members.join(firsts, "label").withColumn("__stays", F.col("place").eqNullSafe(F.col("first"))).where(
        "NOT __stays OR n > 1").select(
        F.col("doc_id").alias("__mark_id"), F.col("text_hash").alias("__mark_hash"), "__stays"))
    same = given["doc_id"].eqNullSafe(F.col("__mark_id")) & (F.xxhash64("text") == F.col("__mark_hash"))
    left = given.join(marked.hint("shuffle_hash"), same, "left_anti")
    repeated = marked.where("__stays")
    if not repeated.isEmpty():
        hashed = [f.name for f in given.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
        one = given.join(repeated.hint("shuffle_hash"), same).groupBy("__mark_id", "__mark_hash").agg(
            F.min_by(F.struct(*given.columns), F.xxhash64(*hashed)).alias("row"))
        left = left.unionByName(one.select("row.*"))
    return left.select(*[F.col(c if c in ("doc_id", "text") else n).alias(c) for n, c in zip(names, docs.columns)])
