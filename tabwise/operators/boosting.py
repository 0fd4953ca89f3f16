"""Gradient-boosted trees in one job: the trees of Spark's own trainer, grown beside rows that stay where they are.

Spark's trainer starts a job per level of every tree and visits every row's objects each time; with hundreds of trees that
is most of the time. Here rows are put into bins once and written. Then the tasks of one barrier stage hold them as bytes,
count sums per (node, bin) with numpy and add these up after every level, so that every task takes the same splits. The sums
pass through small files below the checkpoint folder: Spark's own ``allGather`` sleeps for a second each time.
Rows, their order, the random numbers of Spark's sampling, candidate thresholds, gains and the choice among equal ones are
Spark's; what comes back is a model of Spark's own class. What is not covered (weights, early stopping, nominal features,
very wide inputs, dynamic allocation) is left to Spark's trainer.
"""

from __future__ import annotations

import json
import math
import posixpath
import tempfile
import time
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import BarrierTaskContext, TaskContext
from pyspark.ml import classification, regression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabwise.session import checkpoint_dir, settle

# Rows of one written block, a multiple of LANE; rows that share one pass of counting; rows worth a task of its own.
BLOCK_ROWS, CHUNK_ROWS, TASK_ROWS = 4096, 65_536, 50_000
# Rows whose random numbers follow from one jump of the generator.
LANE = 64
# Bytes of sums per task and level up to which this trainer is used; bytes of rows a task holds in memory and not in a file.
SUMS_BYTES, HELD_BYTES = 16 << 20, 256 << 20
BLOCKS = "part int, start long, x binary, y binary"
NODES = """treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>,
    rawCount bigint, gain double, leftChild int, rightChild int,
    split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"""
INVALID = -float(np.finfo(float).max)
WORD = (1 << 64) - 1


# Random numbers of java.util.Random and of Spark's XORShiftRandom.

def _murmur(data: bytes, seed: int) -> int:
    """MurmurHash3 of a whole number of 4-byte words."""
    h, mask = seed & 0xFFFFFFFF, 0xFFFFFFFF
    turn = lambda x, r: ((x << r) | (x >> (32 - r))) & mask
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i:i + 4], "little") * 0xCC9E2D51 & mask
        h = (turn(h ^ (turn(k, 15) * 0x1B873593 & mask), 13) * 5 + 0xE6546B64) & mask
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & mask
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & mask
    return h ^ (h >> 16)


def hash_seed(seed: int) -> int:
    data = (seed & WORD).to_bytes(8, "big")
    low = _murmur(data, 0x3C074A61)
    return (_murmur(data, low) << 32) | low


def _step(s):
    """The next state, of numbers or of arrays of them."""
    s = s ^ ((s << 21) & WORD) if isinstance(s, int) else s ^ (s << np.uint64(21))
    s = s ^ (s >> 35) if isinstance(s, int) else s ^ (s >> np.uint64(35))
    return s ^ ((s << 4) & WORD) if isinstance(s, int) else s ^ (s << np.uint64(4))


def _bytewise(columns: list[int]) -> np.ndarray:
    """Tables of a linear map of 64 bits: the image of every byte at each of the eight places."""
    out = np.zeros((8, 256), np.uint64)
    for place in range(8):
        for value in range(1, 256):
            low = value & -value
            out[place, value] = out[place, value ^ low] ^ np.uint64(columns[8 * place + low.bit_length() - 1])
    return out


def _mapped(table: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = table[0][v & np.uint64(255)]
    for place in range(1, 8):
        out = out ^ table[place][(v >> np.uint64(8 * place)) & np.uint64(255)]
    return out


def jumps(count: int) -> list[np.ndarray]:
    """Maps that move a generator on by 2 * LANE steps, twice as many, and so on."""
    columns, out = [_step(1 << i) for i in range(64)], []
    for power in range((2 * LANE).bit_length() - 1 + count):
        table = _bytewise(columns)
        if 1 << power >= 2 * LANE:
            out.append(table)
        columns = [int(c) for c in _mapped(table, np.array(columns, np.uint64))]
    return out


class Draws:
    """Which rows a tree sees: one number per row of a partition, in its order, from wherever a block of it starts."""

    def __init__(self, parts: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.parts, self.of = np.unique(parts, return_inverse=True)
        lanes = -(-lengths // LANE)
        self.owner = np.repeat(self.of, lanes)
        first = np.cumsum(lanes) - lanes
        number = np.arange(lanes.sum()) - np.repeat(first, lanes) + np.repeat(starts // LANE, lanes)
        bits = int(number.max()).bit_length() if len(number) else 0
        self.tables = jumps(bits)
        self.moved = [np.flatnonzero(number >> k & 1) for k in range(bits)]
        # A block may end inside its last lane.
        self.valid = np.ones((len(number), LANE), bool)
        self.valid[(first + lanes - 1)[lanes > 0]] = np.arange(LANE) < (lengths - (lanes - 1) * LANE)[lanes > 0, None]

    def below(self, share: float, seed: int) -> np.ndarray:
        state = np.array([hash_seed(seed + int(p) + 1) for p in self.parts], np.uint64)[self.owner]
        for table, at in zip(self.tables, self.moved):
            state[at] = _mapped(table, state[at])
        out = np.empty((len(state), LANE), bool)
        for i in range(LANE):
            state = _step(state)
            high = (state & np.uint64((1 << 26) - 1)) << np.uint64(27)
            state = _step(state)
            out[:, i] = (high + (state & np.uint64((1 << 27) - 1))) * 2.0**-53 < share
        return out[self.valid]


class Subsets:
    """Features that a node may split on: a reservoir sample, seeded from one generator per tree."""

    def __init__(self, seed: int, features: int, chosen: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)
        self.features, self.chosen = features, chosen

    def _next(self) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        found = self.state >> 16
        return found - (1 << 32) if found >> 31 else found

    def draw(self) -> list[int]:
        held = list(range(self.chosen))
        if self.chosen == self.features:
            return held
        state = hash_seed((self._next() << 32) + self._next())
        for item in range(self.chosen, self.features):
            state = _step(state)
            high = (state & ((1 << 26) - 1)) << 27
            state = _step(state)
            at = int((high + (state & ((1 << 27) - 1))) * 2.0**-53 * (item + 1))
            if at < self.chosen:
                held[at] = item
        return held


# Thresholds, splits and trees.

def thresholds(values: np.ndarray, rows: int, share: float, most: int) -> np.ndarray:
    """Candidate thresholds of a feature from a sample of its values, ``share`` of all ``rows``."""
    held = values[values != 0.0]
    if not len(held):
        return np.zeros(0)  # a feature of zeros alone
    found, counts = np.unique(held, return_counts=True)
    counts, expected = counts.astype(float), share * rows
    if expected - len(held) > np.finfo(float).eps * len(held) * 100:
        at = int(np.searchsorted(found, 0.0))
        found, counts = np.insert(found, at, 0.0), np.insert(counts, at, expected - len(held))
    middles = (found[:-1] + found[1:]) / 2.0
    if len(middles) <= most:
        return middles
    stride, out, upto = expected / (most + 1), [], counts[0]
    target = stride
    for i in range(1, len(found)):
        before, upto = upto, upto + counts[i]
        if abs(before - target) < abs(upto - target):
            out.append(middles[i - 1])
            target += stride
    return np.array(out)


def impurity(stats):
    """Variance from (count, sum, sum of squares); 0 without rows."""
    n, total, squares = stats[..., 0], stats[..., 1], stats[..., 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n == 0, 0.0, (squares - total * total / n) / n)


@dataclass
class Node:
    stats: np.ndarray | None = None
    impurity: float = 0.0
    gain: float = -1.0
    feature: int = -1
    bin: int = -1

    @property
    def prediction(self) -> float:
        return float(self.stats[1] / self.stats[0]) if self.stats[0] else 0.0


@dataclass(frozen=True)
class Settings:
    """What a task needs to know."""

    classifier: bool
    trees: int
    depth: int
    rate: float
    share: float
    chosen: int
    least_rows: int
    least_weight: float
    least_gain: float
    seed: int
    marks: tuple[np.ndarray, ...]
    tasks: int = 1


def split_gains(sums: np.ndarray, nodes: list[Node], asked: list[list[int]], s: Settings):
    """(gains, left stats, right stats) of every node, feature and bin; INVALID where a split is not allowed.

    ``sums`` is (nodes, features, bins, 3), with empty bins after a feature's last one.
    """
    upto = np.cumsum(sums, axis=2)
    left, right = upto[:, :, :-1], upto[:, :, -1:] - upto[:, :, :-1]
    for i, (node, chosen) in enumerate(zip(nodes, asked)):
        if node.stats is None:  # the root is what its first split divides
            first = next((f for f in chosen if len(s.marks[f])), None)
            node.stats = upto[i, 0, -1] if first is None else left[i, first, 0] + right[i, first, 0]
            node.impurity = float(impurity(node.stats))
    n = left[..., 0] + right[..., 0]
    above = np.array([node.impurity for node in nodes])[:, None, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        gains = above - left[..., 0] / n * impurity(left) - right[..., 0] / n * impurity(right)
    fewest = np.minimum(left[..., 0], right[..., 0])
    beyond = np.arange(left.shape[2]) >= np.array([len(m) for m in s.marks])[:, None]
    gains[(fewest < s.least_rows) | (fewest < s.least_weight) | ~(gains >= s.least_gain) | beyond] = INVALID
    return gains, left, right


def _room(shape, kind, held: int):
    """An array, in a file without a name where a task would hold too much."""
    if held <= HELD_BYTES:
        return np.empty(shape, kind)
    with tempfile.TemporaryFile() as file:
        return np.memmap(file, kind, "w+", shape=shape)


class Rows:
    """The rows of one task: bins per feature, labels and raw predictions, in the order of their partitions."""

    def __init__(self, batches: Iterator[pa.RecordBatch], s: Settings):
        blocks = [row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(4)))]
        blocks.sort(key=lambda b: b[:2])
        self.s, self.features = s, len(s.marks)
        lengths = np.array([len(b[3]) // 8 for b in blocks], np.int64)
        self.n = n = int(lengths.sum())
        held = n * (self.features + 30)
        self.x, self.y = _room((self.features, n), np.uint8, held), _room(n, float, held)
        at = 0
        for i, (_, _, x, y) in enumerate(blocks):
            part = slice(at, at + int(lengths[i]))
            self.x[:, part] = np.frombuffer(x, np.uint8).reshape(self.features, -1)
            self.y[part] = np.frombuffer(y, float)
            at, blocks[i] = part.stop, blocks[i][:2]  # its bytes are let go
        self.draws = Draws(np.array([b[0] for b in blocks], np.int64), np.array([b[1] for b in blocks], np.int64), lengths)
        self.margin, self.target, self.node = (_room(n, kind, held) for kind in (float, float, np.int32))
        self.margin[:] = 0.0
        if s.classifier:
            self.y[:] = self.y * 2 - 1
        # Counted together: at most CHUNK_ROWS of one partition.
        self.chunks, at = [], 0
        for (part, start), length in zip(blocks, lengths.tolist()):
            last = self.chunks[-1] if self.chunks else None
            if last and last[2] == part and last[3] == start and at - last[0] + length <= CHUNK_ROWS:
                self.chunks[-1] = (last[0], at + length, part, start + length)
            else:
                self.chunks.append((at, at + length, part, start + length))
            at += length

    def begin(self, tree: int) -> None:
        """Pseudo-residuals and the sample of a tree; the first one is fitted on the labels."""
        s = self.s
        drawn = self.draws.below(s.share, s.seed + tree) if s.share < 1 else None
        for a, b, *_ in self.chunks:
            y, margin = self.y[a:b], self.margin[a:b]
            if tree == 0:
                self.target[a:b] = y
            elif s.classifier:
                with np.errstate(over="ignore"):
                    self.target[a:b] = 4.0 * y / (1.0 + np.exp(2.0 * y * margin))
            else:
                self.target[a:b] = 2.0 * (y - margin)
        self.node[:] = 1
        self.drawn = drawn

    def count(self, slots: np.ndarray, nodes: int, features: list[int]) -> np.ndarray:
        """(nodes, features, bins, 3) sums of the sampled rows; ``slots`` gives a node's place, or -1."""
        wide = max(len(m) for m in self.s.marks) + 1
        out = np.zeros((nodes, self.features, wide, 3))
        for a, b, *_ in self.chunks:
            slot = slots[self.node[a:b]]
            keep = slot >= 0
            if self.drawn is not None:
                keep &= self.drawn[a:b]
            at = np.flatnonzero(keep)
            if not len(at):
                continue
            base = slot[at] * wide
            r = self.target[a:b][at]
            squares = r * r
            for f in features:
                bins = base + self.x[f, a:b][at]
                for k, weights in enumerate((None, r, squares)):
                    out[:, f, :, k] += np.bincount(bins, weights, nodes * wide).reshape(nodes, wide)
        return out

    def move(self, feature: np.ndarray, bins: np.ndarray) -> None:
        """Rows of split nodes go on to a child."""
        for a, b, *_ in self.chunks:
            node = self.node[a:b]
            at = np.flatnonzero(feature[node] >= 0)
            mine = node[at]
            right = self.x[feature[mine], a + at] > bins[mine]
            self.node[a + at] = 2 * mine + right

    def end(self, values: np.ndarray, weight: float) -> None:
        for a, b, *_ in self.chunks:
            self.margin[a:b] += values[self.node[a:b]] * weight


def grow(rows: Rows, tree: int, gather) -> dict[int, Node]:
    """One tree; nodes are numbered as in a heap, the root is 1."""
    s = rows.s
    nodes, todo = {1: Node()}, [1]
    subsets = Subsets(s.seed + tree, len(s.marks), s.chosen)
    ends = np.cumsum([len(m) + 1 for m in s.marks])
    rows.begin(tree)
    size = 2 ** (s.depth + 1)
    filled = np.arange(max(len(m) for m in s.marks) + 1) <= np.array([len(m) for m in s.marks])[:, None]
    while todo:
        # A level is a stack in Spark: what was put on it last comes first.
        asked, held = [subsets.draw() for _ in todo], [nodes[number] for number in todo]
        slots = np.full(size, -1)
        slots[todo] = np.arange(len(todo))
        wanted = sorted({f for chosen in asked for f in chosen if len(s.marks[f])}) or [0]
        sums = rows.count(slots, len(todo), wanted)
        sums[:, filled] = gather(sums[:, filled])
        gains, left, right = split_gains(sums, held, asked, s)
        feature, bins, below = np.full(size, -1), np.zeros(size, int), []
        for i, (number, chosen, node) in enumerate(zip(todo, asked, held)):
            # Of equal gains the first counts, in the order of the features drawn.
            best = max([f for f in chosen if len(s.marks[f])], key=lambda f: gains[i, f].max(), default=None)
            gain = INVALID if best is None else float(gains[i, best].max())
            if gain == INVALID:
                node.impurity = -1.0
            if gain <= 0:
                continue
            at = int(np.argmax(gains[i, best]))
            node.gain, node.feature, node.bin = gain, best, at
            feature[number], bins[number] = best, at
            for child, stats in ((2 * number, left[i, best, at]), (2 * number + 1, right[i, best, at])):
                nodes[child] = Node(stats, float(impurity(stats)))
                if number.bit_length() < s.depth and abs(nodes[child].impurity) >= np.finfo(float).eps:
                    below.insert(0, child)
        todo = below
        rows.move(feature, bins)
    values = np.zeros(size)
    for number, node in nodes.items():
        values[number] = node.prediction
    rows.end(values, 1.0 if tree == 0 else s.rate)
    return nodes


def saved(tree: int, nodes: dict[int, Node], marks) -> list[dict]:
    """Rows of a tree in the form of Spark's saved models: numbered from the root, left before right."""
    out = []

    def put(number: int) -> int:
        node, place = nodes[number], len(out)
        leaf = {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}
        row = {"id": place, "prediction": node.prediction, "impurity": node.impurity, "impurityStats": node.stats.tolist(),
               "rawCount": int(node.stats[0]), "gain": -1.0, "leftChild": -1, "rightChild": -1, "split": leaf}
        out.append({"treeID": tree, "nodeData": row})
        if node.feature >= 0:
            left, right = put(2 * number), put(2 * number + 1)
            if out[left]["nodeData"]["leftChild"] < 0 and out[right]["nodeData"]["leftChild"] < 0 and (
                    out[left]["nodeData"]["prediction"] == out[right]["nodeData"]["prediction"]):
                del out[place + 1:]  # two leaves that say the same
            else:
                split = {"featureIndex": node.feature, "leftCategoriesOrThreshold": [float(marks[node.feature][node.bin])],
                         "numCategories": -1}
                row.update(gain=node.gain, leftChild=left, rightChild=right, split=split)
        return place

    put(1)
    return out


class Exchange:
    """Sums over all tasks of a barrier stage: the first one reads those of the others, adds up and writes the total.

    A file appears only once it is complete, and is deleted when every task must have read it.
    """

    def __init__(self, place: str, rank: int, tasks: int):
        self.system, self.base = fs.FileSystem.from_uri(place)
        self.system.create_dir(self.base, recursive=True)
        self.rank, self.tasks, self.round = rank, tasks, 0

    def _path(self, who, number: int) -> str:
        return posixpath.join(self.base, f"{number}-{who}")

    def _write(self, who, data: bytes) -> None:
        draft = self._path(f"{who}.draft", self.round)
        with self.system.open_output_stream(draft, compression=None) as stream:
            stream.write(data)
        self.system.move(draft, self._path(who, self.round))

    def _read(self, who, like: np.ndarray) -> np.ndarray:
        path, wait = self._path(who, self.round), 0.0005
        while self.system.get_file_info(path).type != fs.FileType.File:  # Spark ends all tasks of the stage if one is lost
            time.sleep(wait)
            wait = min(2 * wait, 0.004)
        with self.system.open_input_stream(path, compression=None) as stream:
            return np.frombuffer(stream.read()).reshape(like.shape)

    def __call__(self, mine: np.ndarray) -> np.ndarray:
        self.round += 1
        if self.rank:
            self._write(self.rank, mine.tobytes())
            return self._read("sum", mine)
        total = mine.copy()
        for rank in range(1, self.tasks):
            total += self._read(rank, mine)
            self.system.delete_file(self._path(rank, self.round))
        if self.round > 1:
            self.system.delete_file(self._path("sum", self.round - 1))
        self._write("sum", total.tobytes())
        return total


def _trainer(s: Settings, schema: pa.Schema, place: str):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, gather = 0, lambda mine: mine
        if s.tasks > 1:
            context = BarrierTaskContext.get()
            rank = context.partitionId()
            attempt = context.allGather(uuid4().hex)[0]  # each attempt of the stage has files of its own
            gather = Exchange(f"{place}/sums-{attempt}", rank, s.tasks)
        rows = Rows(batches, s)
        for tree in range(s.trees):
            found = saved(tree, grow(rows, tree, gather), s.marks)
            if rank == 0:  # all tasks have the same trees
                yield pa.RecordBatch.from_pylist(found, schema)

    return train


def _binner(marks: tuple[np.ndarray, ...]):
    """Rows of a partition in order, as blocks of one byte per feature and row."""
    def put(part: int, start: int, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        bins = np.array([np.searchsorted(m, x[:, f]) for f, m in enumerate(marks)], np.uint8)
        return pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "start": pa.array([start], pa.int64()),
            "x": pa.array([bins.tobytes()], pa.binary()), "y": pa.array([y.tobytes()], pa.binary())})

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        x, y = np.zeros((0, len(marks))), np.zeros(0)
        for batch in batches:
            x = np.concatenate((x, batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(marks))))
            y = np.concatenate((y, batch.column(1).to_numpy(zero_copy_only=False)))
            while len(y) >= BLOCK_ROWS:
                yield put(part, start, x[:BLOCK_ROWS], y[:BLOCK_ROWS])
                x, y, start = x[BLOCK_ROWS:], y[BLOCK_ROWS:], start + BLOCK_ROWS
        if len(y):
            yield put(part, start, x, y)

    return binned


def features_per_node(strategy: str, n: int) -> int:
    """Spark's names, a number or a share of the features; a single tree takes all by default."""
    named = {"auto": n, "all": n, "sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log(n) / math.log(2))),
             "onethird": math.ceil(n / 3.0)}
    strategy = strategy.lower()
    if strategy in named:
        return named[strategy]
    return min(int(strategy), n) if strategy.isdigit() else math.ceil(float(strategy) * n)


def _slots(df: DataFrame) -> int:
    context = df.sparkSession.sparkContext._jsc.sc()
    return context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())


def _prepared(estimator, dataset: DataFrame, classifier: bool) -> tuple[Settings, DataFrame] | None:
    """Settings and (array, label) rows; None where Spark's own trainer has to do it."""
    get, spark = estimator.getOrDefault, dataset.sparkSession
    features, label = get("featuresCol"), get("labelCol")
    declared = (dataset.schema[features].metadata or {}).get("ml_attr", {}).get("attrs", {})
    if (
        any(estimator.hasParam(p) and estimator.isSet(p) for p in ("weightCol", "validationIndicatorCol", "leafCol"))
        or "nominal" in declared or "binary" in declared or get("maxBins") > 256
        or get("lossType") != ("logistic" if classifier else "squared")
        or spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true"
    ):
        return None
    rows = dataset.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    plain = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    fine = plain(F.col("y")) & F.col("x").isNotNull() & F.forall("x", plain)
    if classifier:
        fine = fine & F.col("y").isin(0.0, 1.0)
    n, good, width, least = rows.agg(
        F.count(F.lit(1)), F.count(F.when(fine, 1)), F.max(F.size("x")), F.min(F.size("x"))).first()
    if not n or good != n or width != least or not width:
        return None  # Spark says what is wrong
    bins = min(get("maxBins"), n)
    nodes = 2 ** (get("maxDepth") - 1) if get("maxDepth") else 1
    tasks = max(1, min(_slots(dataset), -(-n // TASK_ROWS)))
    if nodes * width * bins * 32 > min(get("maxMemoryInMB") << 20, SUMS_BYTES):
        return None
    sampled, share = rows, max(bins * bins, 10_000) / n
    if share < 1:
        shuffled = spark._jvm.org.apache.spark.util.random.XORShiftRandom(get("seed")).nextInt()
        drawn = rows._jdf.javaRDD().sample(False, share, shuffled)
        sampled = DataFrame(spark._jsparkSession.createDataFrame(drawn, rows._jdf.schema()), spark)
    values = np.array([r[0] for r in sampled.select("x").collect()]).reshape(-1, width)  # about 10,000 rows
    marks = tuple(thresholds(values[:, f], n, min(share, 1.0), bins - 1) for f in range(width))
    return Settings(
        classifier, get("maxIter"), get("maxDepth"), get("stepSize"), get("subsamplingRate"),
        features_per_node(get("featureSubsetStrategy"), width), get("minInstancesPerNode"),
        get("minWeightFractionPerNode") * n, get("minInfoGain"), get("seed"), marks, tasks), rows


def fit_trees(estimator, dataset: DataFrame, kind: type, classifier: bool):
    """A model of Spark's class ``kind``; None where Spark's own trainer has to do it."""
    prepared = _prepared(estimator, dataset, classifier)
    if prepared is None:
        return None
    settings, rows = prepared
    spark = dataset.sparkSession
    blocks = settle(rows.mapInArrow(_binner(settings.marks), BLOCKS))
    dealt = blocks.repartition(settings.tasks)
    form = T.StructType.fromDDL(NODES)
    place = f"{checkpoint_dir(spark)}/boosted-{uuid4().hex}"
    grown = dealt.mapInArrow(_trainer(settings, to_arrow_schema(form), place), form, barrier=settings.tasks > 1)
    grown.write.parquet(f"{place}/data")
    about = {"timestamp": 0, "sparkVersion": spark.version, "paramMap": {"impurity": "variance"}, "defaultParamMap": {}}
    package = "org.apache.spark.ml"
    tree = {**about, "class": f"{package}.regression.DecisionTreeRegressionModel", "numFeatures": len(settings.marks),
            "paramMap": {**about["paramMap"], "maxDepth": settings.depth, "seed": settings.seed}}
    ensemble = {**about, "class": f"{package}.{'classification' if classifier else 'regression'}.{kind.__name__}",
                "uid": estimator.uid, "numFeatures": len(settings.marks), "numTrees": settings.trees}
    spark.createDataFrame([(json.dumps(ensemble),)], "value string").coalesce(1).write.text(f"{place}/metadata")
    listed = [(i, json.dumps({**tree, "uid": f"dtr_{uuid4().hex[:12]}"}), settings.rate if i else 1.0) for i in range(settings.trees)]
    spark.createDataFrame(listed, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{place}/treesMetadata")
    model = kind.load(place)
    model._resetUid(estimator.uid)
    return estimator._copyValues(model)


class GBTClassifier(classification.GBTClassifier):
    def _fit(self, dataset: DataFrame):
        return fit_trees(self, dataset, classification.GBTClassificationModel, True) or super()._fit(dataset)


class GBTRegressor(regression.GBTRegressor):
    def _fit(self, dataset: DataFrame):
        return fit_trees(self, dataset, regression.GBTRegressionModel, False) or super()._fit(dataset)
