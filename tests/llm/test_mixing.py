from collections import defaultdict
from hashlib import md5

from tabwise.llm import mixing
from tests.llm.conftest import clashing, documents


def brute(rows):
    sized = [(r[0], "b" if r[3] is None else "a" + r[3], len((r[1] or "").split())) for r in rows]
    sources = defaultdict(int)
    for _, key, size in sized:
        sources[key] += size
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(sorted(sources))}
    target, rest, open_ = {}, 1.5 * sum(sources.values()), set(sources)
    while open_:
        level = rest / sum(weight[k] for k in open_)
        full = {k for k in open_ if level * weight[k] > 2 * sources[k]}
        for k in full:
            target[k] = 2.0 * sources[k]
            rest -= target[k]
        if not full:
            target |= {k: level * weight[k] for k in open_}
            break
        open_ -= full
    return sized, sources, target


def test_targets_and_mix(docs):
    sized, sources, target = brute(documents())
    got = mixing.report(clashing(docs)).collect()
    assert sorted((r.doc_id, r.size, r.source_size) for r in got if r.doc_id is not None) == sorted(
        (d, s, sources[k]) for d, k, s in sized if d is not None)
    by_size = {sources[k]: (target[k], k) for k in sources}
    largest, taken = defaultdict(int), defaultdict(int)
    for r in got:
        goal, key = by_size[r.source_size]
        assert abs(r.target - goal) < 1e-6 * max(1, goal)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[key] += r.taken
        largest[key] = max(largest[key], r.size)
    for key in sources:
        assert abs(taken[key] - target[key]) <= 2 * max(largest.values())
    assert sum(taken.values()) <= 1.5 * sum(sources.values())


def test_queue_order_is_by_virtual_finish_time(spark, shared):
    """Against a plain queue: sort all copies by finish time, take until the budget is full."""
    rows = [(i, "w " * (1 + i % 5), "en", f"s{i % 3}", 0) for i in range(200)]
    sized, sources, target = brute(rows)
    upto, copies = defaultdict(int), []
    for doc_id, key, size in sorted(sized, key=lambda x: (x[1], md5(str(x[0]).encode()).hexdigest())):
        upto[key] += size
        copies += [((upto[key] + c * sources[key]) / target[key], key, c, doc_id, size) for c in (0, 1)]
    want, total = defaultdict(int), 0
    for _, _, _, doc_id, size in sorted(copies):
        total += size
        if total > 1.5 * sum(sources.values()):
            break
        want[doc_id] += size
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 7):
        got = {r.doc_id: r.taken for r in mixing.report(df.repartition(parts)).collect()}
        assert got == {r[0]: want[r[0]] for r in rows}


def test_mixed_documents_keep_columns(docs, no_docs):
    wide = clashing(docs)
    mixed = mixing.mixed_documents(wide)
    assert mixed.columns == wide.columns
    words = sum(len((r.text or "").split()) for r in mixed.collect())
    assert words == sum(r.taken for r in mixing.report(docs).collect())
    assert mixing.report(no_docs).collect() == [] and mixing.mixed_documents(no_docs).collect() == []
