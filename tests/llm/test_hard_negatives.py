import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwise.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<double>"


def vectors(n=260, d=6, seed=8):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(4)]
    rows = []
    for i in range(n):
        label = rng.choice([0, 0, 1, 2])
        rows.append((i, label, [c + rng.gauss(0, 0.7) for c in centres[rng.choice([label, 3])]]))
    rows += [(n + i, 1, rows[0][2]) for i in range(40)]  # ties
    return rows + [(400, None, rows[0][2]), (420, 0, None), (440, 0, [None] * d), (460, 1, [float("nan")] * d),
                   (480, 1, [float("inf")] * d), (None, 0, rows[0][2]), (20, 0, rows[3][2]), (20, 2, rows[4][2]),
                   (500, 0, []), (501, 1, []), (520, 0, [1.0, 2.0]), (521, 0, [2.0, 1.5]), (522, 1, [1.0, 1.0])]


def brute(rows, every, positives, negatives, low=30, high=90):
    ok = [(i, l, [math.floor(256 * c) for c in v]) for i, l, v in rows
          if i is not None and l is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    asked = {}
    for (i, l, v), raw in zip(ok, [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None
                                   and all(c is not None and math.isfinite(c) for c in r[2])]):
        if i % every == 0 and (i not in asked or (l, raw[2]) < asked[i][0]):
            asked[i] = ((l, raw[2]), v)
    out = []
    for a, ((label, _), v) in asked.items():
        scored = [(-sum(x * y for x, y in zip(v, w)), i, l) for i, l, w in ok if i != a and len(w) == len(v)]
        for ps, p, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            fit = [(s, i) for s, i, l in scored if l != label and -low * ps <= -100 * s <= -high * ps]
            out += [(a, p, r + 1, i, -ps, -s) for r, (s, i) in enumerate(sorted(fit)[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("positives,negatives,layout", [
    (5, 10, {}), (3, 4, {"asked_rows": 3, "strip_bytes": 2000, "block_rows": 17}), (2, 1000, {"block_rows": 1}),
])
def test_mining_is_exact(spark, shared, positives, negatives, layout):
    df = spark.createDataFrame(vectors(), SCHEMA).repartition(3)
    df = df.withColumns({c: F.lit(0) for c in ("anchor_id", "rank", "row", "place", "lot", "positives", "a.b")})
    got = hard_negatives.mine(df, df.where("vec_id % 20 = 0"), positives, negatives, **layout).collect()
    assert sorted(map(tuple, got)) == brute(vectors(), 20, positives, negatives)
    assert got


@pytest.mark.parametrize("size,held", [(20, True), (500, True), (4000, False), (1 << 20, False), (1 << 24, False), (0, True)])
def test_packed_products_are_exact(size, held):
    rng = np.random.default_rng(size)
    rows, anchors = rng.integers(-size, size + 1, (37, 33)), rng.integers(-size, size + 1, (5, 33))
    packing = hard_negatives.Packing(rows, int(anchors.min()), int(anchors.max()))
    assert packing.held == held and packing.fields > 1
    exact = anchors.astype(object) @ rows.T.astype(object)
    assert (packing.scores(anchors) == exact).all()


def test_packing_bounds_that_are_reached():
    rows, anchors = np.full((3, 64), 255), np.full((2, 64), -255)
    rows[1], anchors[1] = -255, 255
    packing = hard_negatives.Packing(rows, -255, 255)
    assert (packing.scores(anchors) == anchors @ rows.T).all()


def test_empty_tables(spark, shared):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(0, 1, [1.0]), (1, 1, [1.0])], SCHEMA)
    for a, b in ((none, none), (some, none), (some, some)):
        assert hard_negatives.mine(a, b).collect() == []
