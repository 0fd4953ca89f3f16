import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabwise.llm import suffix_dedup
from tabwise.llm.suffix_array import suffix_array
from tests.llm.conftest import clashing

N = suffix_dedup.LENGTH


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 3))
def test_suffix_array(symbols, times):
    symbols = symbols * times
    assert suffix_array(np.array(symbols, np.int64)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    counts = Counter(r[s:s + N] for r in raws for s in range(len(r) - N + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for s in range(len(r) - N + 1):
            if counts[r[s:s + N]] > 1:
                gone[s:s + N] = b"\1" * N
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(c for c, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefg hé") for _ in range(n))
    shared, exact, long = noise(900), noise(N), noise(3000)
    edges = [noise(200) + shared[a:a + 420 + a % 7] + noise(150) for a in range(0, 400, 13)]
    changed = []
    for k in range(30):
        near = list(long)
        for _ in range(6):
            near[rng.randrange(len(near))] = rng.choice("XYZ")
        changed.append("".join(near))
    return [None, "", "short", "a" * 399, "a" * 400, "b" * 1000, "ab" * 450, noise(700), long, long, exact, exact[:-1],
            "x" + exact + "y", exact.encode()[:-1].decode("utf-8", "ignore") + "z", shared, shared + noise(10) + shared,
            *edges, *changed, " " * 450 + noise(100), noise(5) + " " * 401]


@pytest.mark.parametrize("block", [suffix_dedup.BLOCK_CONTEXTS, 1])
@pytest.mark.parametrize("piece", [None, 1500])
def test_removed_bytes_match_brute_force(spark, shared, monkeypatch, block, piece):
    monkeypatch.setattr(suffix_dedup, "BLOCK_CONTEXTS", block)
    if piece:  # texts in overlapping parts; run in this process, since workers read the module anew
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        raws = [t.encode() for t in texts() if t and len(t.encode()) >= N]
        starts = [[] for _ in raws]
        for data, edges, numbers, offsets in suffix_dedup._pieces(raws):
            text, first, count, *_ = suffix_dedup.runs_of(data, edges)
            for t, f, c in zip(text, first, count):
                starts[numbers[t]] += range(f + offsets[t], f + offsets[t] + c)
        assert [sorted(s) for s in starts] == [list(range(len(r) - N + 1)) for r in raws]
        return
    given = texts()
    rows = [(i, t) for i, t in enumerate(given)]
    want = dict(enumerate(brute(given)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.report(clashing(df)).collect()}
    assert got == want


def test_repeated_rows_and_null_ids(spark, shared, no_docs):
    rng = random.Random(3)
    text, other = ("".join(rng.choice("abc d") for _ in range(600)) for _ in range(2))
    rows = [(1, text), (1, text), (None, other), (None, other + "!"), (2, "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r)[:4] for r in suffix_dedup.report(df.where("doc_id IS NOT NULL")).collect())
    assert got == [(1, 600, 600, 1), (1, 600, 600, 1), (2, 4, 0, 0)]
    got = sorted(tuple(r)[1:4] for r in suffix_dedup.report(df).collect())
    assert got == [(4, 0, 0), (600, 600, 1), (600, 600, 1), (600, 600, 1), (601, 600, 1)]
    assert suffix_dedup.report(no_docs).collect() == []


def alike():
    """Two different texts of one string each whose sums of bytes times powers agree modulo 2^64 for every odd base."""
    change = np.ones(1, int)
    for gap in (2, 3, 4, 8, 8, 16, 16, 24, 32, 32, 48, 64):  # base^gap - 1 is divisible by a power of two
        change = np.convolve(change, [-1, *[0] * (gap - 1), 1])
    rng = random.Random(1)
    while True:
        low = [rng.randrange(97, 115) for _ in change]
        rest = "".join(rng.choice("abcdefghij klmnop") for _ in range(N - len(change)))
        pair = ["".join(chr(c + max(k, 0)) for c, k in zip(low, (side * change).tolist())) + rest for side in (1, -1)]
        anchors = {suffix_dedup.runs_of(np.frombuffer(t.encode(), np.uint8), np.array([0, N]))[4][0] for t in pair}
        if len(anchors) == 1:
            return pair


@pytest.mark.parametrize("block", [suffix_dedup.BLOCK_CONTEXTS, 1])
def test_texts_with_equal_sums_stay(spark, shared, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK_CONTEXTS", block)
    one, other = alike()
    assert one != other and len(one) == len(other) == N
    given = [one, other, "x" + one[1:]]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.report(df).collect()}
    assert got == dict(enumerate(brute(given)))
    assert {r[1] for r in got.values()} == {0}
