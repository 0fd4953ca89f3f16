"""Hard-negative mining with Kronecker-packed products.

Components become integers, ``floor(256 * x)``. To score candidates against an anchor, the components of several candidates
are made non-negative by a bias and packed into separated fields of one wide integer; one multiplication per anchor
component and one addition then serve all of them, and the fields of the sum, less what the biases added, are the exact
inner products. Fields are as wide as the largest possible sum, so none runs into the next. Wide integers of up to 53 bits
are held in doubles, whose products and sums are exact there; where two fields need more, Python's unbounded integers of
``WIDE_BITS`` take their place.

For each anchor the best rows of its label are its positives. For each positive the best rows of other labels whose score
lies between ``low`` and ``high`` percent of the positive's are its hard negatives. Higher scores come first, ties by id.

Defined results. Rows with a null id, label or vector, or a null or non-finite component take no part. Vectors of different
lengths are not compared. All rows with an anchor's id count as its own and are neither its positives nor its negatives; of
repeated anchor ids the smallest (label, vector) is used. Repeated rows each take a rank. Components are clipped at
``LIMIT`` in size. An anchor without positives, or a positive without negatives, gives no row. Other columns are ignored.

Scale. Anchors and rows meet as blocks (``crossing``); a unit returns at most ``positives`` or ``positives * negatives``
rows per anchor, however hot a label is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwise.llm.common import cut
from tabwise.llm.crossing import cross, matrices
from tabwise.llm.topk import usable

SCALE, LIMIT = 256, 1 << 24
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
WORD_BITS, WIDE_BITS = 53, 1024


def as_integers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * values.astype(np.float64)), -LIMIT, LIMIT).astype(np.int64)


class Packing:
    """Candidates (rows of integers) packed for anchors whose components lie within given bounds."""

    def __init__(self, rows: np.ndarray, least: int, most: int):
        self.n, self.d = rows.shape
        self.sums = rows.sum(axis=1)
        self.bias = max(0, -int(rows.min(initial=0)))
        self.anchor_bias = max(0, -least)
        largest = self.d * (most + self.anchor_bias) * (int(rows.max(initial=0)) + self.bias)
        self.width = max(1, largest.bit_length())
        self.held = 2 * self.width <= WORD_BITS  # wide integers fit doubles
        self.fields = WORD_BITS // self.width if self.held else max(1, WIDE_BITS // self.width)
        kind = np.float64 if self.held else object
        lots = -(-self.n // self.fields)
        padded = np.zeros((lots * self.fields, self.d), np.int64)
        padded[:self.n] = rows + self.bias
        padded = padded.reshape(lots, self.fields, self.d)
        self.words = np.zeros((lots, self.d), kind)
        for f in range(self.fields):
            self.words = self.words + padded[:, f].astype(kind) * (1 << self.width * f if not self.held else 2.0 ** (self.width * f))

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products, anchors x candidates."""
        biased = anchors + self.anchor_bias
        product = biased.astype(self.words.dtype) @ self.words.T
        out = np.empty((len(anchors), self.words.shape[0], self.fields), np.int64)
        if self.held:
            product = product.astype(np.int64)
        mask = (1 << self.width) - 1
        extra = self.bias * anchors.sum(axis=1)[:, None] + self.d * self.anchor_bias * self.bias
        for f in range(self.fields):
            out[:, :, f] = ((product >> self.width * f) & mask).astype(np.int64)
        out = out.reshape(len(anchors), -1)[:, :self.n]
        return out - extra - self.anchor_bias * self.sums[None, :]


class Best:
    """The k best (score, id) of each of many queries so far; ``floor`` is the score that the next must reach."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, np.iinfo(np.int64).min)
        self.q, self.s, self.i = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, q: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
        q, s, i = np.concatenate((self.q, q)), np.concatenate((self.s, s)), np.concatenate((self.i, i))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        kept, last = place < self.k, place == self.k - 1
        self.floor[q[last]] = s[last]
        self.q, self.s, self.i = q[kept], s[kept], i[kept]


def _blocks(asked: pa.RecordBatch | None, rows: Iterator[pa.RecordBatch]):
    """(asked row numbers, asked ids and labels, candidates' ids and labels, scores) for every two blocks of one length."""
    if asked is None:
        return
    ids, labels = asked.column("vec_id").to_numpy(), asked.column("label").to_numpy()
    groups = {x.shape[1]: (at, x) for at, x in matrices(asked.column("embedding"), as_integers)}
    for batch in rows:
        row_ids, row_labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
        for at, x in matrices(batch.column("embedding"), as_integers):
            if x.shape[1] in groups:
                mine, anchors = groups[x.shape[1]]
                packing = Packing(x, int(anchors.min(initial=0)), int(anchors.max(initial=0)))
                other = ids[mine][:, None] != row_ids[at][None, :]
                same = labels[mine][:, None] == row_labels[at][None, :]
                yield mine, row_ids[at], packing.scores(anchors), other, same


def _positives(k: int):
    def task(asked, rows):
        best = Best(asked.num_rows if asked is not None else 0, k)
        for mine, ids, scores, other, same in _blocks(asked, rows):
            q, c = np.nonzero(other & same & (scores >= best.floor[mine][:, None]))
            best.add(mine[q], scores[q, c], ids[c])
        anchors = asked.column("vec_id").take(pa.array(best.q)) if asked is not None else pa.array([], pa.int64())
        return pa.table({"anchor_id": anchors, "positive_id": pa.array(best.i), "positive_score": pa.array(best.s)})
    return task


def share(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """``percent`` of integer scores, rounded up or down, without overflow."""
    whole, rest = np.divmod(score, 100)
    return whole * percent + (-((-rest * percent) // 100) if up else rest * percent // 100)


def _negatives(places: int, k: int, low: int, high: int):
    names = ["anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"]

    def task(asked, rows):
        n = asked.num_rows if asked is not None else 0
        best = Best(n * places, k)
        score = np.zeros(n * places, np.int64)
        known = np.zeros(n * places, bool)
        positive = np.zeros(n * places, np.int64)
        if n:
            lists = asked.column("positives")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(n) * places, sizes) + lists.flatten().field("place").to_numpy()
            score[at], positive[at] = lists.flatten().field("score").to_numpy(), lists.flatten().field("id").to_numpy()
            known[at] = True
        least, most = share(score, low, True), share(score, high, False)
        for mine, ids, scores, other, same in _blocks(asked, rows):
            different = other & ~same
            for p in range(places):
                at = mine * places + p
                fits = different & known[at][:, None] & (scores <= most[at][:, None])
                fits &= scores >= np.maximum(least[at], best.floor[at])[:, None]
                q, c = np.nonzero(fits)
                best.add(at[q], scores[q, c], ids[c])
        anchors = asked.column("vec_id").take(pa.array(best.q // places)) if n else pa.array([], pa.int64())
        return pa.table([anchors, pa.array((best.q % places).astype(np.int32)), pa.array(positive[best.q]),
                         pa.array(score[best.q]), pa.array(best.i), pa.array(best.s)], names)
    return task


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, **layout: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of every hard negative.

    Both tables have vec_id, label and embedding; ``layout`` sets the sizes of ``crossing.cross``.
    """
    def part(df: DataFrame) -> DataFrame:
        held = df.select("vec_id", F.struct("label", "embedding").alias("row"))
        held = held.select("vec_id", F.col("row.label").cast("long").alias("label"), F.col("row.embedding").alias("embedding"))
        return usable(held.where("label IS NOT NULL"), keep=("label",))

    rows = part(vectors)
    asked = part(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row"))
    asked = cut(asked.select("vec_id", "row.*"))
    found = cross(asked, "vec_id", rows, _positives(positives), "anchor_id long, positive_id long, positive_score long", **layout)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = found.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < positives)
    lists = chosen.groupBy("anchor_id").agg(F.collect_list(F.struct(  # at most ``positives`` of an anchor
        "place", F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives"))
    known = asked.join(lists, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "embedding", "positives")
    hard = cross(known, "vec_id", rows, _negatives(positives, negatives, low, high),
                 "anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long",
                 **layout)
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    return hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
