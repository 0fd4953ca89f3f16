import math
import random

import pytest
from pyspark.sql import functions as F

from tabwise.llm import topk


def vectors():
    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) for _ in range(24)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in centres[i % 6]]) for i in range(500)]
    rows += [(600 + i, [0.5] * 24) for i in range(30)]  # ties
    rows += [(700, None), (701, [1.0, None]), (702, [float("nan")] * 24), (703, [float("inf")] * 24), (None, [1.0] * 24),
             (20, rows[5][1]), (40, rows[40][1]), (720, []), (740, [1.0, 2.0]), (741, [2.0, -1.0])]
    return rows


def brute(rows, k, every):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in rows:
        if i is not None and i % every == 0 and (i, [math.floor(64 * x) for x in v] if v and None not in v and all(map(math.isfinite, v)) else v) in ok:
            asked[i] = min(v, asked.get(i, v))
    out = []
    for i, v in asked.items():
        v = [math.floor(64 * x) for x in v]
        best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i and len(w) == len(v))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("k,strip_bytes", [(20, topk.STRIP_BYTES), (5, 2000), (1000, topk.STRIP_BYTES)])
def test_search_is_exact(spark, shared, k, strip_bytes):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>").repartition(3)
    wide = df.withColumns({c: F.lit(0) for c in ("query_id", "rank", "score", "label")})
    got = topk.top_k(wide, wide.where("vec_id % 20 = 0"), k, strip_bytes).collect()
    assert sorted(map(tuple, got)) == brute(vectors(), k, 20)


@pytest.mark.parametrize("asked", [10, 40, 600])
def test_queries_from_outside_the_table(spark, shared, asked):
    rng = random.Random(4)
    table = [(i, [rng.gauss(0, 0.5) for _ in range(24)]) for i in range(200)]
    outside = [(1000 + i, [rng.gauss(0, 5) for _ in range(24)]) for i in range(asked)]
    schema = "vec_id long, embedding array<double>"
    got = topk.top_k(spark.createDataFrame(table, schema).repartition(2), spark.createDataFrame(outside, schema), 20)
    want = []
    for i, v in outside:
        scores = [(-sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(v, w)), j) for j, w in table]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:20])]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_empty_tables(spark, shared):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(none, none).collect() == []


def test_levels_rule_out_most_pairs():
    """Vectors without common directions: only the finest level tells them apart, and it is the one that is used."""
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 64))
    rows = topk.as_integers(x / np.linalg.norm(x, axis=1, keepdims=True))
    search = topk.Search(np.arange(0, 3000, 20), rows[::20], 20)
    search.scan(np.arange(3000), rows)
    assert search.scored < 0.05 * search.pairs
    exact = rows[::20] @ rows.T
    exact[np.arange(150), np.arange(0, 3000, 20)] = -np.inf
    assert (np.sort(search.s.reshape(150, 20)) == np.sort(exact)[:, -20:]).all()
    # Clustered vectors leave at a coarse level already.
    centres = rng.standard_normal((20, 64)) * 5
    near = topk.as_integers(np.repeat(centres, 100, axis=0) + 0.05 * rng.standard_normal((2000, 64)))
    q, c, threshold = near[:50], near[:1000], np.full(50, float((near[0] ** 2).sum()) * 0.99)
    left = topk.not_ruled_out([topk.statistics(q, 4)], [topk.statistics(c, 4)], (q ** 2).sum(1), (c ** 2).sum(1), threshold)
    assert left.mean() < 0.5
