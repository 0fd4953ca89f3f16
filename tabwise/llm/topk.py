"""Exact top-k search by multi-resolution segment statistics.

A vector is cut into segments, from a few long ones to many short ones; of each segment only mean and deviation are kept.
Between two vectors, segment length times the squared difference of means plus the squared difference of deviations
never exceeds the segment's squared distance. Their sum is a lower bound of the distance, hence an upper bound of the
inner product. Candidates whose bound lies below a query's k-th best score so far drop out at the coarsest resolution
that shows it; the survivors of the finest get their exact score. The finest segments are single components, whose bound
is the distance itself. Of every two blocks a few pairs tell first whether a level rules out enough to pay; it is left out
where not. How many pairs a level can rule out depends on the table: vectors without common directions differ in all
segments alike, and only the finest levels tell them apart.

Vectors are taken as integers, ``floor(64 * x)``; scores are exact while they stay below 2^53.

Defined results. Rows with a null id, a null vector, or a null or non-finite component take no part. Vectors of
different lengths are not compared. All rows with a query's id count as its own and are no candidates of it; of repeated
query ids one vector is used, the smallest. Queries need not be rows of the table. Repeated candidate rows each take a rank. Other columns are ignored.

Scale. Queries grow with the table. Blocks of queries meet strips of rows on the cluster (``crossing``); a unit keeps k rows
per query, so what it emits does not grow with its input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwise.llm.crossing import STRIP_BYTES, cross, matrices

SCALE = 64
SEGMENTS = (4, 16, 32, 64)
#: Candidates and queries of one matrix in a task; candidates that set the first thresholds.
CANDIDATE_ROWS, QUERY_ROWS, SEED_ROWS = 1024, 512, 512
PAIR_ROWS = 20_000
#: Queries and candidates that are tried first, and the share of pairs that a level must rule out among them.
TRIED, PAYS = (32, 128), 0.05


def as_integers(values: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * values.astype(np.float64))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row: means times the root of the segment length, then deviations (root of the summed squares)."""
    width = x.shape[1]
    edges = np.linspace(0, width, min(segments, width) + 1).astype(int)
    out = []
    for a, b in zip(edges, edges[1:]):
        part = x[:, a:b]
        mean = part.mean(axis=1, keepdims=True)
        out.append(mean[:, 0] * np.sqrt(b - a))
        if b - a > 1:
            out.append(np.sqrt(((part - mean) ** 2).sum(axis=1)))
    return np.stack(out, axis=1) if out else np.zeros((len(x), 1))


def over_pairs(mask: np.ndarray, dense, sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, value) where ``mask`` holds: one product of matrices if many are left, else pair by pair."""
    q, c = np.nonzero(mask)
    if len(q) > 0.05 * mask.size:
        return q, c, dense()[q, c]
    parts = [sparse(q[i:i + PAIR_ROWS], c[i:i + PAIR_ROWS]) for i in range(0, len(q), PAIR_ROWS)]
    return q, c, np.concatenate(parts) if parts else np.zeros(0)


def not_ruled_out(q_stats, c_stats, q_norm, c_norm, threshold) -> np.ndarray:
    """Mask of the (query, candidate) pairs that no resolution rules out.

    With both squared norms, a lower bound of the squared distance is an upper bound of the inner product.
    """
    mask = np.ones((len(q_norm), len(c_norm)), bool)
    tried_q, tried_c = (slice(None, None, max(1, -(-n // t))) for n, t in zip(mask.shape, TRIED))
    for q, c in zip(q_stats, c_stats):
        def dense(q=q, c=c, q_norm=q_norm, c_norm=c_norm):
            return (q ** 2).sum(1)[:, None] + (c ** 2).sum(1)[None, :] - 2 * (q @ c.T)

        def sparse(i, j, q=q, c=c):
            return ((q[i] - c[j]) ** 2).sum(1)

        def far(apart, a, b, limit):
            return (a + b - apart) / 2 + 1e-9 * (a + b) + 1e-6 < limit

        few = mask[tried_q, tried_c]
        gone = few & far(dense(q[tried_q], c[tried_c]), q_norm[tried_q, None], c_norm[None, tried_c], threshold[tried_q, None])
        if few.sum() and gone.sum() < PAYS * few.sum():
            continue
        i, j, apart = over_pairs(mask, dense, sparse)
        out = far(apart, q_norm[i], c_norm[j], threshold[i])
        mask[i[out], j[out]] = False
    return mask


class Search:
    """Queries of one vector length with the k best (score, id) of each so far; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.stats, self.norm = [statistics(queries, s) for s in SEGMENTS], (queries ** 2).sum(1)
        self.pairs = self.scored = 0
        self.floor = np.full(len(queries), -np.inf)
        self.q, self.s, self.i = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def seed(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Raise floors to the k-th best score among candidates; k of them reach it, so no better row is lost."""
        if len(rows) < self.k:
            return
        for a in range(0, len(self.queries), QUERY_ROWS):
            b = slice(a, a + QUERY_ROWS)
            scores = self.queries[b] @ rows.T
            scores[self.ids[b, None] == ids[None, :]] = -np.inf
            self.floor[b] = np.maximum(self.floor[b], np.partition(scores, -self.k, axis=1)[:, -self.k])

    def scan(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Take in candidates, given as integer rows."""
        for c in range(0, len(rows), CANDIDATE_ROWS):
            part, part_ids = rows[c:c + CANDIDATE_ROWS], ids[c:c + CANDIDATE_ROWS]
            if np.isneginf(self.floor).any():
                seeds = max(SEED_ROWS, 2 * self.k)
                self.seed(part_ids[:seeds], part[:seeds])
            stats, norm = [statistics(part, s) for s in SEGMENTS], (part ** 2).sum(1)
            found = []
            for a in range(0, len(self.queries), QUERY_ROWS):
                b = slice(a, a + QUERY_ROWS)
                mask = not_ruled_out([q[b] for q in self.stats], stats, self.norm[b], norm, self.floor[b])
                queries = self.queries[b]
                self.pairs, self.scored = self.pairs + mask.size, self.scored + int(mask.sum())
                qi, ci, scores = over_pairs(mask, lambda: queries @ part.T,  # noqa: B023 - called at once
                                            lambda i, j: np.einsum("ij,ij->i", queries[i], part[j]))  # noqa: B023
                good = (scores >= self.floor[b][qi]) & (self.ids[b][qi] != part_ids[ci])
                found.append((qi[good] + a, scores[good], part_ids[ci[good]]))
            self.keep(*[np.concatenate(x) for x in zip(*found)])

    def keep(self, q: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
        q, s, i = np.concatenate((self.q, q)), np.concatenate((self.s, s)), np.concatenate((self.i, i))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        kept, last = place < self.k, place == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])
        self.q, self.s, self.i = q[kept], s[kept], i[kept]


def usable(vectors: DataFrame, ids: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, ``keep`` and embedding of the rows that take part; without ``ids``, a null id does not matter."""
    value = F.col("embedding")
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), *keep, "embedding").where(
        (F.col("vec_id").isNotNull() | F.lit(not ids)) & value.isNotNull() & ~bad)


def _search(k: int):
    def task(asked: pa.RecordBatch | None, blocks: Iterator[pa.RecordBatch]) -> pa.Table:
        searches = {}
        if asked is not None:
            ids = asked.column("vec_id").to_numpy()
            searches = {x.shape[1]: Search(ids[at], x, k) for at, x in matrices(asked.column("embedding"), as_integers)}
        for batch in blocks:
            ids = batch.column("vec_id").to_numpy()
            for at, rows in matrices(batch.column("embedding"), as_integers):
                if rows.shape[1] in searches:
                    searches[rows.shape[1]].scan(ids[at], rows)
        columns = [[s.ids[s.q] for s in searches.values()], [s.i for s in searches.values()],
                   [s.s.astype(np.int64) for s in searches.values()]]
        return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in columns],
                        ["query_id", "vec_id", "score"])
    return task


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, strip_bytes: int = STRIP_BYTES) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of ``vectors`` for every row of ``queries``."""
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    best = cross(asked, "vec_id", usable(vectors), _search(k), "query_id long, vec_id long, score long", strip_bytes=strip_bytes)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
