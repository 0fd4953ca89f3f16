import re

import pytest

from tabwise.llm import decontaminate
from tests.llm.conftest import clashing, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def items():
    rows = documents()
    return [(1, " ".join(rows[3][1].split()[:14])), (2, "KÜCHE señor-maß"), (3, None), (4, ""), (5, "..."),
            (1, " ".join(rows[3][1].split()[:14])), (None, rows[9][1]), (12, rows[10][1].upper())]


def brute(rows, benchmark):
    windows = {}
    for item, text in benchmark:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i:i + 10]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((doc_id, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_chars", [decontaminate.BLOCK_CHARS, 150])
def test_scan_matches_brute_force(spark, docs, block_chars):
    benchmark = spark.createDataFrame(items(), "item_id long, text string")
    got = decontaminate.scan(clashing(docs), clashing(benchmark), ["doc_id"], block_chars=block_chars).collect()
    assert sorted(((r.doc_id, r.n_words, len(r.hit), r["items"], bool(r.hit)) for r in got), key=repr) == brute(
        documents(), items())


def test_spans_point_into_the_original_text(spark, shared):
    text = "¡Été!  The LIGHT,\tand wind -- over stone; 数据 end"
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, "light and WIND over"), (8, "数据")], "item_id long, text string")
    (row,) = decontaminate.scan(rows, benchmark, ["doc_id"]).collect()
    assert [text[s.start:s.end] for s in row.spans] == ["LIGHT,\tand wind -- over", "数据"]


def test_clean_documents_stay_whole(spark, docs, no_docs):
    benchmark = spark.createDataFrame(items(), "item_id long, text string")
    wide = clashing(docs)
    clean = decontaminate.drop_contaminated(wide, benchmark)
    assert clean.columns == wide.columns
    want = sorted((r[0] for r in brute(documents(), items()) if not r[4]), key=repr)
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == want
    assert decontaminate.report(no_docs, benchmark).collect() == []
    none = benchmark.where("false")
    assert not any(r.contaminated for r in decontaminate.report(docs, none).collect())
