import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwise.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


def vectors(n=300, d=12, seed=2):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0.1 * j, 1 / (1 + j)) for j in range(d)]) for i in range(n)]
    return rows + [(n, None), (n + 1, [None] * d), (n + 2, [float("nan")] * d), (n + 3, [float("-inf")] + [0.0] * (d - 1)),
                   (None, [0.5] * d), (5, rows[5][1]), (5, rows[6][1]), (n + 4, [1.0, 2.0]), (n + 5, [])]


def brute(rows, d):
    held = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in rows
            if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    n, sums = len(held), [sum(v[j] for _, v in held) for j in range(d)]
    centred = np.array([[n * x - s for x, s in zip(v, sums)] for _, v in held], float) / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    deviation = [sum((n * x - s) ** 2 for x, s in zip(v, sums)) for _, v in held]
    return [i for i, _ in held], centred @ axes / np.sqrt(values), values / np.trace(cov), deviation, n


def test_whitening_agrees_with_a_dense_solver(spark, shared):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    df = df.withColumns({c: F.lit(0) for c in ("component", "n", "i", "v", "width")})
    got = whitening.whiten(df).collect()
    ids, white, explained, deviation, n = brute(rows, 12)
    assert len(got) == 8 * len(ids) and {r["n"] for r in got} == {n}
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for c in range(1, 9):
        mine = sorted(((r["vec_id"], r["deviation"], r["whitened"]) for r in got if r["component"] == c), key=key)
        want = sorted(zip(ids, deviation, white[:, c - 1]), key=key)
        assert [(a, b) for a, b, _ in mine] == [(a, b) for a, b, _ in want]
        x, y = np.array([m[2] for m in mine]), np.array([w[2] for w in want])
        assert np.allclose(x, y, rtol=0, atol=1e-9) or np.allclose(x, -y, rtol=0, atol=1e-9)
    assert np.allclose(sorted({r["explained"] for r in got}), sorted(explained), rtol=1e-12)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-12


@pytest.mark.parametrize("d,spectrum", [
    (40, lambda j: 0.999 ** j), (150, lambda j: 1.0 + (j == 3)), (150, lambda j: 2.0 ** -j), (5, lambda j: 1.0),
])
def test_pairs_reach_double_precision(d, spectrum):
    rng = np.random.default_rng(d)
    axes = np.linalg.qr(rng.standard_normal((d, d)))[0]
    matrix = axes @ np.diag([spectrum(j) for j in range(d)]) @ axes.T
    values, vectors = whitening.jacobi_davidson(lambda y: matrix @ y, d, 8, basis=40)
    want = np.sort(np.linalg.eigvalsh(matrix))[::-1][:8]
    assert np.allclose(values, want, rtol=0, atol=1e-13 * want[0])
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-11 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_minres_solves_shared_systems():
    rng = np.random.default_rng(1)
    matrix = rng.standard_normal((20, 20))
    matrix, right = matrix + matrix.T, rng.standard_normal((20, 3))
    assert np.allclose(matrix @ whitening.minres(lambda z: matrix @ z, right, 200), right, atol=1e-6)


def test_low_rank_and_empty_tables(spark, shared):
    flat = [(i, [float(i % 3), 2.0 * (i % 3), 5.0]) for i in range(30)]
    got = whitening.whiten(spark.createDataFrame(flat, SCHEMA)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 30
    for rows in ([], [(1, [1.0, 2.0])], [(i, [3.0]) for i in range(4)], [(1, []), (2, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_huge_entries_stay_exact(spark, shared):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.25, 0.5])]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 3 and all(r["deviation"] is None or r["deviation"] >= 0 for r in got)
    assert got[0]["identity_error"] < 1e-4
