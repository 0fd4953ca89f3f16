import base64
import hashlib

import pytest

from tabwise.llm import warc
from tabwise.llm.common import new_folder

PAGES = [(5, "http://a/5", "<p>same</p>"), (3, "http://a/3", "<p>same</p>"), (9, None, "<p>same</p>"),
         (1, "http://b/\r\nX: y", "WARC/1.1\r\n\r\nnot a record\r\n\r\n"), (2, "http://c", ""), (7, "http://c", None),
         (8, "http://d", "é数\x00" * 1000), (None, "http://e", "<p>same</p>"), (None, "http://f", "only"),
         (3, "http://a/3", "<p>same</p>"), *[(100 + k, f"http://hot/{k}", "hot" * 50) for k in range(200)]]


def brute(pages, min_bytes=0):
    first = {}
    for page, _, html in pages:
        payload = (html or "").encode()
        if page is not None and len(payload) >= min_bytes:
            first[payload] = min(page, first.get(payload, page))
    out = []
    for page, _, html in pages:
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        original = first.get(payload)
        original = None if original == page else original
        out.append((page, len(payload), digest, "response" if original is None else "revisit", original))
    return sorted(out, key=repr)


def test_report_matches_brute_force(spark, shared):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(4)
    wide = pages.withColumns({c: F.lit(1) for c in ("digest", "size", "payload", "first", "n", "type")})
    assert sorted(map(tuple, warc.report(wide).collect()), key=repr) == brute(PAGES)
    assert warc.report(pages.where("false")).collect() == []


@pytest.mark.parametrize("archive_bytes", [500, 10**9])
def test_archives_hold_urls_and_payloads(spark, shared, archive_bytes):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = new_folder(spark, "warc")
    rows = warc.read(spark, folder, warc.write(warc.resolve(pages, 100), folder, archive_bytes)).collect()
    assert len(rows) == len(PAGES)
    kinds = {}
    for r in rows:
        if r.type == "response":
            assert len(r.payload) == r.size
            assert base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode() == r.digest
        else:
            assert r.payload == b"" and r.size >= 100 and r.original is not None
        kinds[r.page_id] = r.url
    assert kinds["1"] == "http://b/%0D%0AX:%20y" and kinds["9"] is None
