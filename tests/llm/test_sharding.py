import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from tabwise.llm import sharding
from tabwise.llm.common import new_folder
from tests.llm.conftest import DOC_SCHEMA, clashing, documents


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_in_steps_of_one(spark, dims, bits):
    names = [f"c{k}" for k in range(dims)]
    cells = spark.createDataFrame(list(product(range(1 << bits), repeat=dims)), ", ".join(f"{n} int" for n in names))
    walked = sharding.hilbert(cells.withColumns({f"k{n}": F.col(n) for n in names}), [f"k{n}" for n in names], bits, "h")
    rows = sorted((r.h, tuple(r[n] for n in names)) for r in walked.collect())
    assert [r[0] for r in rows] == list(range(1 << dims * bits))
    assert all(sum(abs(x - y) for x, y in zip(a[1], b[1])) == 1 for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("shards", [1, 7, 40, 500])
def test_shards_are_equal_runs(docs, shards):
    rows = documents()
    got = sharding.assign(clashing(docs), shards).collect()
    key = lambda d, t: (d is not None, d or 0, t)
    assert sorted(key(r.doc_id, (r["size"], r.text_crc32)) for r in got) == sorted(
        key(r[0], (len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode()))) for r in rows)
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append((r.slot, r.curve))
    counts = [len(by_shard.get(k, [])) for k in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(by_shard) <= set(range(shards))
    ends = []
    for k in sorted(by_shard):
        placed = sorted(by_shard[k])
        assert [s for s, _ in placed] == list(range(len(placed)))
        curve = [c for _, c in placed]
        assert curve == sorted(curve)
        ends.append((curve[0], curve[-1]))
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_written_shards_hold_all_rows(spark, docs, no_docs):
    folder = new_folder(spark, "shards")
    wide = clashing(docs).drop("shard", "a.b")
    sharding.write_shards(wide, folder, 5)
    back = spark.read.parquet(folder)
    assert set(back.columns) == set(wide.columns) | {"shard"}
    want = {}
    for r in sharding.assign(docs, 5).collect():
        want[r.shard] = want.get(r.shard, 0) + 1
    assert {r.shard: r["count"] for r in back.groupBy("shard").count().collect()} == want
    assert sharding.report(no_docs).collect() == []


@pytest.mark.parametrize("rows,shards", [
    ([(i, f"text {i}", "en", f"s{i % 3}", 1) for i in range(40)] + [(7, "repeated", "de", "s1", 2)] * 20, 12),
    ([(1, "a", "en", "s1", 1), (2, "b", "en", "s1", 1)], 40)])
def test_written_shards_are_those_of_assign(spark, shared, rows, shards):
    df = spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)
    folder = new_folder(spark, "shards")
    sharding.write_shards(df, folder, shards)
    key = lambda r: (r.shard, r.doc_id, r["size"])
    back = spark.read.parquet(folder).withColumn("size", F.octet_length("text") + sharding.ROW_OVERHEAD).collect()
    assert sorted(map(key, back)) == sorted(map(key, sharding.assign(df, shards).collect()))


def test_plan_has_no_python(docs):
    plan = sharding.report(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
