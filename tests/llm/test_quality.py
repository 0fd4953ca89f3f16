import math
import random

import pytest
from pyspark.sql import functions as F

from tabwise.llm import quality
from tests.llm.conftest import clashing, documents


def corpus(n=240, seed=1):
    """Good, shouted and insulting documents over hosts with few and many pages."""
    rng, rows, labels = random.Random(seed), [], []
    words = [f"word{k}" for k in range(300)]
    for i in range(n):
        kind = i % 4
        text = " ".join(rng.choice(words) for _ in range(60))
        text = text.upper().replace(" ", "!! ") if kind == 0 else text + " vilewretch you" if kind == 1 else text
        rows.append((i, text, "en", f"host{i % 7}" if i % 5 else None, 0))
        labels.append((i, int(kind != 0), int(kind == 1)))
    return rows, labels


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark, shared):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    trained = [x for x in labels if x[0] % 3]
    got = {r.doc_id: r.keep for r in quality.report(docs, spark.createDataFrame(trained, LABELS)).collect()}
    held = [x for x in labels if x[0] % 3 == 0]
    right = sum(got[i] == (q == 1 and t == 0) for i, q, t in held)
    assert right >= 0.97 * len(held)


def test_sites_shrink_towards_the_prior(spark, shared):
    scored = spark.createDataFrame(
        [("big", "en", 4.0)] * 400 + [("big", "de", -4.0)] * 30 + [("bad", "en", -4.0)] * 400 + [("one", "fr", -4.0)]
        + [(None, None, 4.0)] * 5, "source string, lang string, quality_evidence double").withColumn(
        "worded", F.lit(True))
    heads = [quality.Head("quality", 0.5, None)]
    sites = {(r.source, r.lang): r for r in quality.site_rates(scored, heads).collect()}
    rate = {k: (r.quality_k + r.quality_m * r.quality_host) / (r.n + r.quality_m) for k, r in sites.items()}
    assert rate["big", "en"] > 0.9 > 0.5 > rate["bad", "en"]
    single = rate["one", "fr"]  # one document moves its path little
    assert rate["bad", "en"] < single
    assert abs(sites["one", "fr"].quality_host - 0.5) < abs(sites["bad", "en"].quality_host - 0.5)


@pytest.mark.parametrize("labels", [[], [(0, 1, 0), (1, 1, 0)], [(0, None, None)], [(None, 1, 0)]])
def test_missing_labels(spark, docs, labels):
    given = spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: r.keep for r in quality.report(docs, given).collect()}
    want = {r[0]: bool((r[1] or "").strip()) for r in documents()}
    assert got == want


def test_kept_documents_keep_columns(spark, docs, no_docs):
    rows, labels = corpus(80)
    given = spark.createDataFrame(labels, LABELS)
    wide = clashing(spark.createDataFrame(rows, SCHEMA))
    kept = quality.keep_good(wide, given)
    assert kept.columns == wide.columns
    want = {r.doc_id for r in quality.report(wide, given).collect() if r.keep}
    assert {r.doc_id for r in kept.collect()} == want
    assert quality.report(no_docs, given).collect() == [] and quality.keep_good(no_docs, given).collect() == []


def nested_beta(scored, rates):
    """Brute force of the posteriors: {path: (host rate, path strength)}, votes and global rate by plain sums."""
    def strength(groups, prior):
        n = sum(g[0] for g in groups)
        chance = [prior(i) * (1 - prior(i)) for i in range(len(groups))]
        spread = sum(g[0] * (g[1] / g[0] - prior(i)) ** 2 for i, g in enumerate(groups))
        between = max(0.0, (spread - sum(chance)) / n)
        m = sum(g[0] * c for g, c in zip(groups, chance)) / n / between - 1 if between else quality.STRONGEST
        return min(max(m, quality.WEAKEST), quality.STRONGEST)

    prior = math.log(rates / (1 - rates))
    paths, hosts = {}, {}
    for source, lang, evidence in scored:
        vote = 1 / (1 + math.exp(-(evidence + prior)))
        for table, key in ((paths, (source, lang)), (hosts, source)):
            n, k = table.get(key, (0, 0.0))
            table[key] = n + 1, k + vote
    mean = sum(k for _, k in hosts.values()) / len(scored)
    m = strength(list(hosts.values()), lambda i: mean)
    host_rate = {h: (k + m * mean) / (n + m) for h, (n, k) in hosts.items()}
    keys = list(paths)
    inner = strength([paths[key] for key in keys], lambda i: host_rate[keys[i][0]])
    out = []
    for source, lang, evidence in scored:
        n, k = paths[source, lang]
        own = 1 / (1 + math.exp(-(evidence + prior)))
        site = (max(k - own, 0.0) + inner * host_rate[source]) / (n - 1 + inner)
        out.append((site, 1 / (1 + math.exp(-(evidence + math.log(site / (1 - site)))))))
    return out


def test_posteriors_match_brute_force(spark, shared):
    rng = random.Random(8)
    hosts = {h: rng.uniform(-3, 3) for h in ["a", "b", "c", None]}
    scored = [(h, rng.choice(["en", "de", None]), rng.gauss(hosts[h], 1)) for h in
              (rng.choice(["a", "a", "a", "b", "c", None]) for _ in range(400))] + [("lone", "fr", -1.0)]
    rows = [(i, *x, -x[2] / 2) for i, x in enumerate(scored)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, quality_evidence double, "
                                     "toxic_evidence double").withColumn("worded", F.lit(True))
    heads = [quality.Head("quality", 0.7, None), quality.Head("toxic", 0.2, None)]
    got = {r.doc_id: r for r in quality.combine(df, quality.site_rates(df, heads), heads).collect()}
    good = nested_beta(scored, 0.7)
    bad = nested_beta([(s, c, -e / 2) for s, c, e in scored], 0.2)
    for i, ((site, score), (toxic_site, toxic)) in enumerate(zip(good, bad)):
        row = got[i]
        assert (row.quality_site, row.quality_score) == pytest.approx((site, score), abs=1e-9)
        assert (row.toxic_site, row.toxic_score) == pytest.approx((toxic_site, toxic), abs=1e-9)
        assert row.keep == (score >= 0.5 and toxic < 0.5)


def test_repeated_ids_train_once(spark, shared):
    rows, labels = corpus(80)
    docs, given = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    hot = docs.unionByName(spark.createDataFrame([(0, "zzz later text", "en", "host0", 0)] * 200, SCHEMA))
    plain, crowded = quality.train(docs, given), quality.train(hot, given)
    for a, b in zip(plain, crowded):
        assert a.rate == b.rate
        assert sorted(a.vocabulary.vocabulary) == sorted(b.vocabulary.vocabulary)


def test_working_set_reaches_the_optimum_of_all_features(spark, shared, monkeypatch):
    """Features that join step by step give the fit on all features at once."""
    rows, labels = corpus(160)
    docs, given = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    whole = quality.train(docs, given)
    monkeypatch.setattr(quality, "STEP", 20)
    steps = quality.train(docs, given)
    score = lambda heads: {r.doc_id: (r[1], r[2]) for r in quality.evidence(docs, heads).select(
        "doc_id", "quality_evidence", "toxic_evidence").collect()}
    a, b = score(whole), score(steps)
    assert all(h.model is not None for h in steps)
    assert all((x > 0) == (y > 0) for i in a for x, y in zip(a[i], b[i]))
