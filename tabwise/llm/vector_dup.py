"""Near-duplicate vectors by PCA-ordered tiled comparison.

Equal vectors of a label are one class. Classes become unit vectors and are turned onto principal axes, the strongest
first; a rotation keeps every cosine. Tiles of up to ``TILE`` classes are compared in pairs of the same label: the leading
dimensions are multiplied first, and what the others can add to or take from a cosine is bounded by the product of the two
suffix norms (Cauchy-Schwarz). A pair leaves once the bound shows that its cosine cannot reach the threshold, or that it
must; whole tiles leave once no pair is open. Pairs within ``NEAR`` of the threshold are decided by the cosine of the
vectors as given, in double precision. Along the first axis tiles are sorted, and tiles further apart there than linked
unit vectors can be, ``sqrt(2 - 2 * threshold)``, never meet.

A comparison returns the number of links per class and the edges of a spanning forest, never the pairs; components are
found from the forests.

Defined results. Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label,
link with nothing. Vectors of different lengths are not linked. One row per row of the table: repeated rows are copies of
each other. ``component_id`` is the smallest id in the component that is not null; ``kept`` is false for a null id.
Thresholds are above 0. Other columns are ignored.

Scale. No pair is a row anywhere: a tile is one row, a unit of work one tile with up to ``VISITORS`` others, so that a
group of any size is spread over units of bounded size. Comparing remains quadratic in the classes of a label that lie
close along the first axis, with the bounds leaving a small part of the multiplications. The axes are fitted on
``AXES_ROWS`` classes; they change speed, never results.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwise.llm.common import cut
from tabwise.llm.components import components

THRESHOLD = 0.93
TILE, VISITORS, AXES_ROWS = 1024, 16, 4096
#: Fewer classes make a tile of long vectors.
TILE_BYTES = 1 << 20
#: Leading dimensions after which bounds are taken; share of open pairs below which they are finished one by one.
STAGES, FEW = (4, 8, 16, 32), 0.05
NEAR = 1e-9
SLICE = 20_000
KEY = 16


def keyed(rows: DataFrame) -> DataFrame:
    """vec_id and, of the rows that can be linked, key and vector (doubles as bytes) of their class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, labels, keys, vectors = batch.column(2), batch.column(1).to_pylist(), [], []
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            for label, start, end in zip(labels, np.concatenate(([0], ends[:-1])), ends):
                vector = flat[start:end]
                if label is None or not vector.any():
                    keys.append(None)
                    vectors.append(None)
                    continue
                value = vector.tobytes()
                keys.append(blake2b(repr(label).encode() + b"\0" + value, digest_size=KEY).digest())
                vectors.append(value)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(keys, pa.binary()),
                                   pa.array(vectors, pa.binary())], ["vec_id", "label", "key", "vector"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "embedding").mapInArrow(
        run, f"vec_id long, label {kind}, key binary, vector binary")


def unit(vectors: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(axis=1, keepdims=True)  # scaled first: no square over- or underflows
    scaled = vectors / largest
    return scaled / np.sqrt((scaled ** 2).sum(axis=1, keepdims=True))


def principal_axes(classes: DataFrame, rows: int = AXES_ROWS) -> dict[int, np.ndarray]:
    """Per vector length, principal axes as columns, strongest first, of the classes with the smallest keys."""
    found: dict[int, list[bytes]] = {}
    for row in classes.select("vector").orderBy("key").limit(rows).toLocalIterator():
        found.setdefault(len(row[0]), []).append(bytes(row[0]))
    axes = {}
    for size, held in found.items():
        x = unit(np.frombuffer(b"".join(held)).reshape(len(held), -1))
        axes[size // 8] = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    return axes


def turned(vectors: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    rows = unit(vectors)
    turn = axes.get(rows.shape[1])
    return rows if turn is None else rows @ turn


def tiles(classes: DataFrame, axes, size: int) -> DataFrame:
    """One row per tile: up to ``size`` classes of one label and length, near each other on the first axis."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(3).to_pylist()
            sizes = np.array([len(v) for v in vectors], np.int64)
            first = np.zeros(len(vectors))
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                block = np.frombuffer(b"".join(vectors[i] for i in at)).reshape(len(at), -1)
                first[at] = turned(block, axes.value)[:, 0]
            yield pa.record_batch([*batch.columns, pa.array(first, pa.float64())], [*batch.schema.names, "first"])

    kind = classes.schema["label"].dataType.simpleString()
    placed = classes.select("label", "key", "n", "vector").mapInArrow(
        place, f"label {kind}, key binary, n long, vector binary, first double").withColumn("width", F.length("vector"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        names = ["label", "width", "low", "high", "keys", "weights", "vectors"]

        def tile() -> pa.RecordBatch:
            columns = list(zip(*held))
            return pa.record_batch([
                pa.array([held[0][0]], label_type), pa.array([held[0][5]], pa.int32()), pa.array([min(columns[4])]),
                pa.array([max(columns[4])]), pa.array([b"".join(columns[1])], pa.binary()),
                pa.array([np.array(columns[2], np.int64).tobytes()], pa.binary()),
                pa.array([b"".join(columns[3])], pa.binary())], names)

        for batch in batches:
            label_type = batch.schema.field(0).type
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and (len(held) >= max(1, min(size, TILE_BYTES // row[5])) or held[-1][0] != row[0] or held[-1][5] != row[5]):
                    yield tile()
                    held = []
                held.append(row)
        if held:
            yield tile()

    count = max(1, ceil(classes.count() / (8 * size)))
    dealt = placed.repartitionByRange(count, "label", "width", "first", "key").sortWithinPartitions(
        "label", "width", "first", "key")
    made = dealt.mapInArrow(gather, f"label {kind}, width int, low double, high double, keys binary, weights binary, "
                                    "vectors binary")
    return made.withColumn("tile", F.monotonically_increasing_id())


def certain(a: np.ndarray, b: np.ndarray, threshold: float, stages=STAGES, few: float = FEW):
    """(linked, open, seen): pairs that surely reach the threshold, pairs too near to tell, multiplications made.

    ``a`` and ``b`` are unit rows on principal axes. Dimensions are added up from the strongest on.
    """
    d = a.shape[1]
    tail_a, tail_b = (np.sqrt(np.maximum(np.cumsum(x[:, ::-1] ** 2, axis=1)[:, ::-1], 0)) for x in (a, b))
    rest = lambda tail, at: tail[:, at] if at < d else np.zeros(len(tail))
    linked = np.zeros((len(a), len(b)), bool)
    edges = [0, *[s for s in stages if s < d], d]
    dots, seen = np.zeros(linked.shape), 0
    for start, end in zip(edges, edges[1:]):
        dots += a[:, start:end] @ b[:, start:end].T
        seen += dots.size * (end - start)
        slack = rest(tail_a, end)[:, None] * rest(tail_b, end)[None, :] + NEAR
        linked |= dots - slack >= threshold
        live = ~linked & (dots + slack >= threshold)
        i, j = np.nonzero(live)
        if not len(i) or (end < d and len(i) > few * dots.size):
            if not len(i):
                break
            continue
        if end == d:
            break
        # Few pairs are left: each is finished on its own, in stages again.
        value = dots[i, j]
        for start, stop in [(s, e) for s, e in zip(edges, edges[1:]) if s >= end]:
            added = np.empty(len(i))
            for k in range(0, len(i), SLICE):
                part = slice(k, k + SLICE)
                added[part] = np.einsum("ij,ij->i", a[i[part], start:stop], b[j[part], start:stop])
            value, seen = value + added, seen + len(i) * (stop - start)
            slack = rest(tail_a, stop)[i] * rest(tail_b, stop)[j] + NEAR
            sure = value - slack >= threshold
            linked[i[sure], j[sure]] = True
            left = ~sure & (value + slack >= threshold)
            i, j, value = i[left], j[left], value[left]
        break
    return linked, (i, j), seen


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows as given; scaled by powers of two, so that squares stay finite."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def forest(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that connect what ``linked`` connects; ``a`` and ``b`` are node numbers of rows and columns."""
    label_a, label_b = a.copy(), b.copy()
    big = max(a.max(), b.max()) + 1
    while True:
        new_a = np.minimum(label_a, np.where(linked, label_b[None, :], big).min(axis=1))
        new_b = np.minimum(label_b, np.where(linked, new_a[:, None], big).min(axis=0))
        if (new_a == label_a).all() and (new_b == label_b).all():
            break
        label_a, label_b = new_a, new_b
    nodes, roots = np.concatenate((a, b)), np.concatenate((label_a, label_b))
    moved = nodes != roots
    return nodes[moved], roots[moved]


def _compare(axes, threshold: float):
    def read(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        keys = np.frombuffer(row["keys"], f"S{KEY}")
        raw = np.frombuffer(row["vectors"]).reshape(len(keys), -1)
        return keys, np.frombuffer(row["weights"], np.int64), raw, turned(raw, axes.value)

    def compare(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["side"])
        keys_a, weight_a, raw_a, a = read(rows[0])
        out: list[tuple[bytes, bytes | None, int]] = []
        name = lambda keys, i: bytes(keys[i]).ljust(KEY, b"\0")  # numpy cuts zero bytes off the end
        count_a = np.zeros(len(a), np.int64)
        for row in rows[1:]:
            same = row["tile"] == rows[0]["tile"]
            keys_b, weight_b, raw_b, b = (keys_a, weight_a, raw_a, a) if same else read(row)
            linked, (i, j), _ = certain(a, b, threshold)
            reach = cosines(raw_a[i], raw_b[j]) >= threshold
            linked[i[reach], j[reach]] = True
            if same:
                np.fill_diagonal(linked, False)
            if not linked.any():
                continue
            count_a += linked @ weight_b
            at_a, at_b = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
            if same:
                nodes, roots = forest(linked[np.ix_(at_a, at_a)], at_a, at_a)
                out += {(name(keys_a, n), name(keys_a, r), 0) for n, r in zip(nodes, roots)}
                continue
            counts = weight_a @ linked
            out += [(name(keys_b, k), None, int(counts[k])) for k in at_b]
            shift = len(a)
            nodes, roots = forest(linked[np.ix_(at_a, at_b)], at_a, at_b + shift)
            node = lambda k: name(keys_a, k) if k < shift else name(keys_b, k - shift)  # noqa: B023
            out += [(node(n), node(r), 0) for n, r in zip(nodes, roots)]
        out += [(name(keys_a, k), None, int(count_a[k])) for k in np.flatnonzero(count_a)]
        key, other, n = zip(*out) if out else ((), (), ())
        return pa.table({"key": pa.array(key, pa.binary()), "other": pa.array(other, pa.binary()), "n": pa.array(n, pa.int64())})

    return compare


def links(classes: DataFrame, threshold: float, tile_rows: int = TILE, visitors: int = VISITORS) -> DataFrame:
    """Rows (key, null, n): n further links of a class; rows (key, other, 0): edges of spanning forests."""
    axes = classes.sparkSession.sparkContext.broadcast(principal_axes(classes))
    made = cut(tiles(classes, axes, tile_rows))
    narrow = made.select("tile", "label", "width", "low", "high")
    a, b = (narrow.select("label", "width", *[F.col(c).alias(f"{c}_{s}") for c in ("tile", "low", "high")]) for s in "ab")
    reach = sqrt(max(0.0, 2 - 2 * threshold)) + NEAR
    # Tiles of a label are disjoint runs along the first axis, so the later one of a pair starts later.
    met = a.join(b, ["label", "width"]).where(
        (F.struct("low_b", "tile_b") >= F.struct("low_a", "tile_a")) & (F.col("low_b") <= F.col("high_a") + reach))
    place = F.row_number().over(Window.partitionBy("tile_a").orderBy("tile_b")) - 1
    met = cut(met.select(F.col("tile_a").alias("home"), F.col("tile_b").alias("tile"),
                         F.floor(place / visitors).alias("chunk")))
    full = made.select("tile", "keys", "weights", "vectors")
    visiting = met.join(full, "tile").withColumn("side", F.lit(1))
    homes = met.select("home", "chunk").distinct().join(full.withColumn("home", F.col("tile")), "home").withColumn(
        "side", F.lit(0))
    columns = ["home", "chunk", "side", "tile", "keys", "weights", "vectors"]
    units = homes.select(*columns).unionByName(visiting.select(*columns))
    return units.groupBy("home", "chunk").applyInArrow(_compare(axes, threshold), "key binary, other binary, n long")


def report(vectors: DataFrame, threshold: float = THRESHOLD, tile_rows: int = TILE, visitors: int = VISITORS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    value = F.col("embedding")
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.when(~bad, value).alias("embedding"))
    made = keyed(rows)
    classes = cut(made.where("key IS NOT NULL").groupBy("key").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("n"),
        F.min("vec_id").alias("least")))
    found = cut(links(classes, threshold, tile_rows, visitors))
    near = found.where("other IS NULL").groupBy("key").agg(F.sum("n").alias("near"))
    groups = components(found.where("other IS NOT NULL").select(F.col("key").alias("a"), F.col("other").alias("b")))
    linked = classes.select("key", "n", "least").join(near, "key", "left").join(
        groups, F.col("key") == F.col("node"), "left").where("label IS NOT NULL OR n > 1")
    linked = cut(linked.select("key", (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("n_links"), "least",
                               F.coalesce("label", "key").alias("group")))
    least = linked.groupBy("group").agg(F.min("least").alias("smallest"))
    named = cut(linked.join(least, "group").select("key", "n_links", "smallest", F.lit(True).alias("several")))
    out = made.select("vec_id", "key").join(named, "key", "left")
    component = F.when(F.col("several"), F.col("smallest")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
