"""Embedding whitening by Jacobi-Davidson with matrix-free distributed products.

The covariance V of the vectors is never formed. ``V @ Y`` for a few columns Y is one pass over the rows: each task centres
its rows, multiplies them with Y and then with the products, and sends back a matrix of Y's shape. On that product rests
the eigenvalue method. A search space is kept; Rayleigh-Ritz in it gives the leading pairs; leading pairs whose residual
has reached double precision are locked; for the others the projected correction equation
``(I - UU')(V - theta I)(I - UU') t = -r`` is solved by a few steps of MINRES, all of them sharing one pass per step, and
the corrections extend the space, which restarts from its best Ritz vectors once it is full.

Entries c become the integer ``floor(1024 * c) + 100000``, kept within 2^40 of zero. With the integer sums S of the n
rows, ``n * x - S`` is the exact centred value times n, so the offset costs no digits.

Defined results. Rows with a null vector or a null or non-finite entry take no part; neither do rows whose length is not
the most frequent one (ties: the longer). Null and repeated ids are kept: one row per row and component. Only components
with an eigenvalue above ``d * 2^-52`` of the largest are returned: one row, or equal rows, have none, and an empty table
gives no rows. ``deviation`` is null where it exceeds a long. Other columns are ignored.

Scale. Rows are persisted (and recomputed if an executor is lost); a pass sends ``d x 8`` numbers to each task and the
same back, summed by position on the cluster. Only matrices of that size and the search space of at most ``BASIS``
columns live on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwise.llm.topk import usable

SCALE, OFFSET, LIMIT = 1024, 100_000, 1 << 40
COMPONENTS = 8
#: Columns of the search space, and MINRES steps of a correction.
BASIS, INNER, OUTER = 72, 3, 500
EPS = np.finfo(float).eps
#: Residual norm, as a part of the largest eigenvalue, at which a pair is locked; and up to which one is accepted that
#: rounding keeps from falling any further.
LOCKED, ROUNDING = 64 * EPS, 1e-11
LONG = (1 << 63) - 1


def as_integers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * values.astype(np.float64)) + OFFSET, -LIMIT, LIMIT).astype(np.int64)


def integers(column: pa.Array, width: int) -> np.ndarray:
    """Integer matrix of a column of lists of equal length."""
    return as_integers(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)


def summed(rows: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], width: int, kind: str) -> dict[int, object]:
    """Sum of ``kernel`` over all rows, by position in its result: one matrix per task, added up on the cluster."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = kernel(integers(batch.column(0), width))
                total = part if total is None else total + part
        if total is not None:
            flat = total.ravel()
            yield pa.record_batch([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "v"])

    exact = F.col("v").cast("decimal(38,0)") if kind == "long" else F.col("v")
    parts = rows.select("embedding").mapInArrow(run, f"i long, v {kind}")
    return {r["i"]: r["s"] for r in parts.groupBy("i").agg(F.sum(exact).alias("s")).collect()}


class Centred:
    """Rows times n minus sums: exact where they fit a long, in Python's integers elsewhere."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums

    def whole(self, x: np.ndarray) -> np.ndarray:
        largest = max(int(np.abs(x).max()) if x.size else 0, 1) * self.n + max(map(abs, self.sums), default=0)
        if largest < LONG:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.whole(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> pa.Array:
        whole = self.whole(x)
        if whole.dtype != object and whole.size and float(np.abs(whole).max()) ** 2 * whole.shape[1] < LONG:
            return pa.array((whole * whole).sum(axis=1))
        exact = (whole.astype(object) ** 2).sum(axis=1) if whole.size else []
        return pa.array([v if v <= LONG else None for v in exact], pa.int64())


def orthonormal(vectors: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Orthonormal columns of what ``vectors`` add to the orthonormal columns of ``against``."""
    for _ in range(2):
        for basis in against:
            vectors = vectors - basis @ (basis.T @ vectors)
    if not vectors.shape[1]:
        return vectors
    u, s, _ = np.linalg.svd(vectors, full_matrices=False)
    u = u[:, s > 1e-10 * max(s[0], np.finfo(float).tiny)]
    for basis in against:
        u = u - basis @ (basis.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


def minres(operator: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of symmetric systems, one per column, that share every product."""
    x, w, w_old = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    r_old, r, y = np.zeros_like(right), right, right
    beta = np.linalg.norm(right, axis=0)
    floor = 4 * EPS * beta + np.finfo(float).tiny
    beta_old = np.ones_like(beta)
    dbar, eps, phibar = np.zeros_like(beta), np.zeros_like(beta), beta.copy()
    cs, sn = -np.ones_like(beta), np.zeros_like(beta)
    for step in range(steps):
        live = beta > floor
        if not live.any():
            break
        safe = np.where(live, beta, 1.0)
        v = y / safe
        y = operator(v)
        if step:
            y = y - beta / beta_old * r_old
        alpha = (v * y).sum(axis=0)
        y = y - alpha / safe * r
        r_old, r, beta_old = r, y, safe
        beta = np.linalg.norm(y, axis=0)
        eps_old, delta, gbar = eps, cs * dbar + sn * alpha, sn * dbar - cs * alpha
        eps, dbar = sn * beta, -cs * beta
        gamma = np.maximum(np.hypot(gbar, beta), np.finfo(float).tiny)
        cs, sn = gbar / gamma, beta / gamma
        phi, phibar = cs * phibar, sn * phibar
        w, w_older, w_old = (v - eps_old * w_old - delta * w) / gamma, w_old, w
        x = x + np.where(live, phi, 0.0) * w
    return x


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, seed: int = 5,
                    basis: int = BASIS, inner: int = INNER) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, vectors as columns) of the ``wanted`` largest pairs of the symmetric ``product``, by falling value."""
    wanted, basis = min(wanted, d), max(basis, 3 * wanted)
    locked, values = np.zeros((d, 0)), np.zeros(0)
    q = orthonormal(np.random.default_rng(seed).standard_normal((d, min(d, wanted + 2))))
    aq = product(q)
    best, stalled = np.inf, 0
    for _ in range(OUTER):
        h = q.T @ aq
        theta, s = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-theta)
        theta, x, ax = theta[order], q @ s[:, order], aq @ s[:, order]
        scale = max(np.abs(np.concatenate((values, theta))).max(), np.finfo(float).tiny)
        left = wanted - len(values)
        residual = ax[:, :left] - x[:, :left] * theta[:left]
        residual -= locked @ (locked.T @ residual)
        norms = np.linalg.norm(residual, axis=0)
        stalled = stalled + 1 if norms[0] > 0.5 * best else 0
        best = min(best, norms[0])
        full = q.shape[1] + len(values) == d  # the space is everything, and the Ritz pairs are exact up to rounding
        bound = (ROUNDING if full or stalled > 3 else LOCKED) * scale
        done = int(np.argmax(np.append(norms > bound, True)))
        if done:
            # What is locked has been judged by a product of its own, not by one carried through changes of basis.
            checked = product(x[:, :done])
            theta_done = (x[:, :done] * checked).sum(axis=0)
            off = checked - x[:, :done] * theta_done
            off = np.linalg.norm(off - locked @ (locked.T @ off), axis=0)
            ax[:, :done] = checked
            done = int(np.argmax(np.append(off > bound, True)))
        if done:
            locked, values = np.hstack((locked, x[:, :done])), np.concatenate((values, theta_done[:done]))
            x, ax, theta, residual = x[:, done:], ax[:, done:], theta[done:], residual[:, done:]
            best, stalled = np.inf, 0
            if len(values) == wanted:
                break
            q, aq = orthonormal(x, locked), None
            if q.shape[1] < x.shape[1]:
                aq = product(q)
            else:
                aq = ax @ (x.T @ q)
            if not residual.shape[1]:
                continue
        left = wanted - len(values)
        u, shift = x[:, :left], theta[:left]

        def project(z, u=u, locked=locked):
            z = z - locked @ (locked.T @ z)
            return z - u * (u * z).sum(axis=0)

        t = minres(lambda z: project(product(project(z)) - project(z) * shift), -project(residual[:, :left]), inner)  # noqa: B023
        if q.shape[1] + left > basis:
            keep = min(basis - left, 2 * wanted)
            q, aq = x[:, :keep], ax[:, :keep]
        t = orthonormal(project(t), locked, q)
        if not t.shape[1]:
            t = orthonormal(np.random.default_rng(seed + q.shape[1]).standard_normal((d, left)), locked, q)
            if not t.shape[1]:
                continue
        q, aq = np.hstack((q, t)), np.hstack((aq, product(t)))
    else:
        raise RuntimeError("the eigenvectors did not converge")
    order = np.argsort(-values, kind="stable")
    return values[order], locked[:, order]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row and component."""
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = usable(vectors, ids=False)
    size = F.size("embedding").alias("width")
    common = fit.groupBy(size).count().orderBy(F.desc("count"), F.desc("width")).first()
    if common is None or not common["width"]:
        return spark.createDataFrame([], schema)
    d, n = common["width"], common["count"]
    fit = fit.where(F.size("embedding") == d)
    held = fit.select("embedding").persist()
    try:
        sums = summed(held, lambda x: x.sum(axis=0), d, "long")
        centred = Centred(n, [int(sums[i]) for i in range(d)])

        def product(columns: np.ndarray) -> np.ndarray:
            def part(x: np.ndarray) -> np.ndarray:
                rows = centred.rows(x)
                return rows.T @ (rows @ columns)

            found = summed(held, part, d, "double")
            return np.array([found[i] for i in range(columns.size)]).reshape(columns.shape) / n

        trace = summed(held, lambda x: np.array([(centred.rows(x) ** 2).sum()]), d, "double")[0] / n
        values, axes = jacobi_davidson(product, d, components) if trace > 0 else (np.zeros(0), np.zeros((d, 0)))
        kept = values > d * EPS * max(values.max(initial=0.0), 0.0)
        values, axes = values[kept], axes[:, kept]
        if not len(values):
            return spark.createDataFrame([], schema)
        onto = axes / np.sqrt(values)

        def moments(x: np.ndarray) -> np.ndarray:
            white = centred.rows(x) @ onto
            return np.vstack((white.T @ white, white.sum(axis=0)))

        k = len(values)
        found = summed(held, moments, d, "double")
        moment = np.array([found[i] for i in range((k + 1) * k)]).reshape(k + 1, k) / n
    finally:
        held.unpersist()
    error = float(np.abs(moment[:k] - np.outer(moment[k], moment[k]) - np.eye(k)).max())
    explained = values / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column(1), d)
            rows = np.repeat(np.arange(len(x)), k)
            yield pa.record_batch([
                batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(rows), n)), centred.deviations(x).take(pa.array(rows)),
                pa.array((centred.rows(x) @ onto).ravel()), pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(rows), error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return fit.mapInArrow(project, schema)
