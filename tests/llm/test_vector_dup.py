import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwise.llm import vector_dup

SCHEMA = "vec_id long, label int, embedding array<float>"


def vectors(n=240, d=20, seed=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(8)]
    rows = []
    for i in range(n):
        centre = centres[rng.randint(0, 7)] if i % 3 else centres[0]
        spread = rng.choice([0.02, 0.2, 0.6])
        rows.append((i, rng.choice([0, 0, 1]), [c + rng.gauss(0, spread) for c in centre]))
    rows += [(n + i, 0, rows[0][2]) for i in range(90)]  # a group of exact copies
    rows += [(n + 100, 0, [3 * x for x in rows[0][2]]), (n + 101, 0, [-x for x in rows[0][2]])]
    rows += [(n + 110, None, rows[0][2]), (n + 111, 0, None), (n + 112, 0, [0.0] * d), (n + 113, 0, [None] * d),
             (n + 114, 0, [float("nan")] * d), (n + 115, 0, [float("inf")] * d), (n + 116, 0, []), (n + 117, 0, [1.0, 2.0]),
             (n + 118, 0, [2.0, 4.0]), (None, 0, rows[0][2]), (7, 0, rows[7][2]), (7, 1, rows[9][2])]
    return rows


def brute(rows, threshold):
    x = [(l, None if v is None or l is None or not v or any(c is None or not math.isfinite(c) for c in v)
          or not any(v) else np.array(v, np.float32).astype(float)) for _, l, v in rows]
    links = {i: set() for i in range(len(rows))}
    for i, (la, a) in enumerate(x):
        for j, (lb, b) in enumerate(x):
            if i != j and a is not None and b is not None and la == lb and len(a) == len(b):
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
                    links[i].add(j)
    out = []
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo = [j for k in todo for j in links[k] if j not in seen]
            seen |= set(todo)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        smallest = min(ids) if ids else None
        out.append((row[0], len(links[i]), smallest, row[0] is not None and row[0] == smallest))
    return sorted(out, key=repr)


@pytest.mark.parametrize("threshold,tile,visitors", [(0.93, 1024, 16), (0.93, 16, 3), (0.8, 7, 2), (0.99, 40, 1)])
def test_links_and_components(spark, shared, threshold, tile, visitors):
    df = spark.createDataFrame(vectors(), SCHEMA).repartition(4)
    df = df.withColumns({c: F.lit(0) for c in ("key", "n", "tile", "low", "vector", "n_links", "kept", "a.b")})
    got = vector_dup.report(df, threshold, tile, visitors).collect()
    assert sorted(map(tuple, got), key=repr) == brute(vectors(), threshold)


@pytest.mark.parametrize("stages,few", [((4, 8, 16), 0.05), ((1, 2, 3), 1.0), ((), 0.0), ((8,), 0.5)])
def test_bounds_lose_no_pair(stages, few):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 24)) * np.linspace(3, 0.2, 24)
    a = vector_dup.unit(np.vstack((base, base + 0.3 * rng.standard_normal(base.shape))))
    exact = a @ a.T
    linked, (i, j), seen = vector_dup.certain(a, a, 0.9, stages, few)
    linked[i, j] = exact[i, j] >= 0.9
    away = np.abs(exact - 0.9) > 1e-12
    assert (linked == (exact >= 0.9))[away].all()
    assert seen <= a.shape[0] ** 2 * 24


def test_most_pairs_leave_early():
    rng = np.random.default_rng(4)
    a = vector_dup.unit(rng.standard_normal((400, 64)))
    _, _, seen = vector_dup.certain(a, a, 0.93)
    assert seen < 0.45 * 400 * 400 * 64


def test_forest_connects_what_is_linked():
    rng = np.random.default_rng(5)
    for _ in range(20):
        linked = rng.random((12, 15)) < 0.08
        nodes, roots = vector_dup.forest(linked, np.arange(12), np.arange(12, 27))
        def parts(edges):
            edges, label = list(edges), list(range(27))
            for _ in range(27):
                for a, b in edges:
                    label[a] = label[b] = min(label[a], label[b])
            return label
        assert parts(zip(nodes, roots)) == parts((i, 12 + j) for i, j in zip(*np.nonzero(linked)))


def test_empty_table(spark, shared):
    assert vector_dup.report(spark.createDataFrame([], SCHEMA)).collect() == []
    only = spark.createDataFrame([(1, None, [1.0]), (2, 3, None)], SCHEMA)
    assert sorted(map(tuple, vector_dup.report(only).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
