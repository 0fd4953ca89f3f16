import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwise.llm import near_dup
from tabwise.llm.common import LEAST_TASKS
from tabwise.llm.components import components
from tabwise.llm.hashing import shingles, word_hashes
from tests.llm.conftest import clashing, sentence


def texts(seed=6):
    rng = random.Random(seed)
    out = [None, "", " \t", "one", "ONE", "one two", "two one", "one two three", "One  two\nTHREE"]
    base = sentence(rng, 150).split()
    vocabulary = [f"w{k}" for k in range(5000)]
    base = [rng.choice(vocabulary) for _ in range(200)]
    for _ in range(80):  # a family of near copies, some of them just above or below the threshold
        near = list(base)
        for _ in range(rng.randint(0, 12)):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        out.append(" ".join(near))
    chain = [rng.choice(vocabulary) for _ in range(150)]
    for k in range(12):  # each near the next, the ends far apart
        chain = list(chain)
        for p in range(4):
            chain[(13 * k + 37 * p) % 150] = rng.choice(vocabulary)
        out.append(" ".join(chain))
    out += [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(30)]
    return out + out[10:14] + [out[40].upper()]


def brute(rows, width, hundredths):
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        runs = [tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
        sets.append(set(runs))
    label = list(range(len(rows)))
    changed = True
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b])
             >= hundredths * len(sets[a] | sets[b]) and sets[b]]
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    groups = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            groups[label[k]] = min(doc_id, groups.get(label[k], doc_id))
    return [(d, len(s), groups.get(label[k]), d is not None and d == groups[label[k]])
            for k, ((d, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("width,hundredths", [(3, 85), (5, 80)])
@pytest.mark.parametrize("block_rows", [near_dup.BLOCK_ROWS, 4])
def test_components_match_brute_force(spark, shared, monkeypatch, width, hundredths, block_rows):
    import functools
    monkeypatch.setattr(near_dup, "connecting_links", functools.partial(near_dup.connecting_links, block_rows=block_rows))
    given = texts()
    rows = list(zip(random.Random(1).sample(range(1000), len(given)), given)) + [(None, given[12]), (None, "alone no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = near_dup.report(clashing(df), width, hundredths / 100).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows, width, hundredths), key=repr)


def test_one_document_stays(spark, shared, no_docs):
    given = texts()
    rows = [(k, t) for k, t in enumerate(given)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns
    want = {d for d, _, _, keep in brute(rows, 5, 80) if keep}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert near_dup.report(no_docs).collect() == [] and near_dup.keep_one(no_docs).collect() == []


def test_one_row_stays_of_repeated_rows_and_missing_ids(spark, shared):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(100)) for _ in range(6)]
    near = texts[1] + " end"
    rows = [(1, texts[0], "x"), (1, texts[0], "x"), (1, texts[0], "y"), (2, texts[0], "z"),  # the kept row repeats
            (None, texts[1], "a"), (None, texts[1], "a"), (None, near, "b"),  # no id in the whole group
            (None, texts[2], "c"), (5, texts[2], "d"), (5, texts[2], "d"),  # an id beside none
            (6, texts[3], "e"), (6, texts[3] + " end", "f"),  # one id, two texts
            (7, texts[4], "g"), (7, texts[5], "h"), (None, None, "i"), (None, None, "i"), (8, "", "j")]  # apart
    df = spark.createDataFrame([(*r, {"k": r[2]}) for r in rows], "doc_id long, text string, note string, m map<string,string>")
    kept = near_dup.keep_one(df.repartition(3)).collect()
    assert all(r.m == {"k": r.note} and (r.doc_id, r.text, r.note) in rows for r in kept)
    groups = ["xyz", "ab", "cd", "ef", "g", "h", "j"]
    assert [sum(r.note in g for r in kept) for g in groups] == [1] * len(groups)
    assert sum(r.note == "i" for r in kept) == 2 and len(kept) == len(groups) + 2
    assert {r.doc_id for r in kept if r.note in "xyzcd"} == {1, 5}


def test_small_graphs_take_few_tasks(spark, shared):
    """Links in many partitions, as many shuffle partitions leave them, end in few: each leaves files of its own."""
    chain = spark.range(0, 300, 1, 64).select((F.col("id") * 2).alias("a"), (F.col("id") * 2 + 2).alias("b"))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = components(chain.unionByName(chain).unionByName(spark.createDataFrame([(901, 903), (903, 905)], "a long, b long")))
        assert found.rdd.getNumPartitions() <= LEAST_TASKS
        got = {r.node: r.label for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert got == {2 * k: 0 for k in range(301)} | {901: 901, 903: 901, 905: 901}


@pytest.mark.parametrize("few_groups", [near_dup.FEW_GROUPS, 0])
def test_large_groups_connect_with_and_without_broadcast(spark, shared, monkeypatch, few_groups):
    monkeypatch.setattr(near_dup, "FEW_GROUPS", few_groups)
    sets = [set(range(k, k + 100)) for k in (0, 1, 2, 3, 500, 501, 900)] + [set(range(0, 100, 2))]
    rows = [(g, bytes([g, k]), np.array(sorted(s), np.uint64).tobytes()) for g in (1, 2) for k, s in enumerate(sets)]
    rows += [(3, b"\3\0", rows[0][2]), (3, b"\3\1", rows[1][2]), (4, b"\4\0", rows[0][2])]
    members = spark.createDataFrame(rows, "g long, id binary, payload binary")
    links = near_dup.connecting_links(members, near_dup.Sets, 0.85, block_rows=3)
    got = {bytes(r.node): bytes(r.label) for r in components(links).collect()}
    want = {bytes([g, k]): bytes([g, 0 if k < 4 else 4]) for g in (1, 2) for k in range(6)}
    assert got == want | {b"\3\0": b"\3\0", b"\3\1": b"\3\0"}


def test_words_hash_alike_in_any_company():
    rng = random.Random(2)
    pool = [" ".join(rng.choice(["a", "B", "é", "longer", "x" * 50]) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    alone = [next(word_hashes([t])).tolist() for t in pool]
    assert [w.tolist() for w in word_hashes(pool)] == alone
    assert len(shingles(next(word_hashes(["a b"])), 3)) == 1


def test_bounds():
    for t in (0.8, 0.85):
        assert (1 - t ** near_dup.ROWS) ** near_dup.bands(t) <= near_dup.MISS
        assert near_dup.least_agreements(t, 16) < near_dup.least_agreements(t, 64) < 64 * t
