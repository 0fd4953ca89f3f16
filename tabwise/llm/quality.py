"""Quality classifier: document evidence combined with hierarchical empirical-Bayes site posteriors.

Two heads, quality and toxicity, are logistic regressions over the words of a document, the beginnings of its words and
binned style measures, fitted on labelled documents. The document's log-likelihood ratio is one part of the evidence; where it comes from is the other.
Rates of hosts (``source``) and of paths below them (``source``, ``lang``) are posterior means of nested Beta models: a
path is shrunk towards its host, a host towards the global rate, each with a strength estimated from the spread between
sites beyond chance. Sites with few documents thus take the global prior. A document's own vote is left out of its path.

A document is kept if quality is likelier than not and toxicity is not.

Training uses at most ``MAX_LABELLED`` labelled documents, those with the smallest hash of their id, and of rows that
repeat an id the one with the smallest text; every feature that occurs in ``LEAST_SHARE`` of them takes part. The L1
penalty leaves most weights at zero, so a head is fitted on a working set and the gradients of all features are added up
on the cluster: those that the optimum of all features would use join the set until there are none. All sites and rates
are computed over all documents.

Defined results. Null texts and texts without words are rejected, with quality 0. Null sources and languages are sites of
their own. A null label does not train its head; a head whose labels show one class only gives no document evidence, and
that class as its rate. Without labels everything with words is kept. Repeated rows are judged each. Other columns stay
as they are.

Scale. Texts outside the sample are never shuffled: the labelled sample is broadcast by its bound, sites are map-side
sums, and the site table joins back by Spark's own size check, else with skew splitting.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwise.llm.common import cut, fresh
from tabwise.session import settle

MAX_LABELLED = 20_000
#: Share of the sample's documents in which a feature occurs at least; all such features are kept.
LEAST_SHARE = 0.0005
#: Lengths of the beginnings by which inflected and compound words share evidence.
PREFIXES = (4, 5)
ROUNDS = 60
#: Features that join a working set at once, and the slack of their gradient over the penalty.
STEP, SLACK = 4000, 1.1
PARTS = 4
#: Weight of the absolute penalty, which leaves only words that tell something.
PENALTY = 3e-4
HEADS = ("quality", "toxic")
#: Bounds of a site prior's strength, in documents.
WEAKEST, STRONGEST = 1.0, 1e6


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _binned(name: str, share: Column, bins: int = 12) -> Column:
    return F.concat(F.lit(f"\x01{name}="), F.least(F.floor(share * bins), F.lit(bins)).cast("string"))


def _prefixes(distinct: Column, length: int) -> Column:
    return F.transform(distinct, lambda w: F.concat(F.lit(f"\x02{length}"), F.substring(w, 1, length)))


def features(text: Column, found: Column, distinct: Column) -> Column:
    """Distinct words and beginnings of words, and style measures as words of their own."""
    size = F.greatest(F.length(text), F.lit(1))
    lines = F.split(text, "\n")
    count = F.greatest(F.size(found), F.lit(1))
    style = F.array(
        _binned("capitals", F.regexp_count(text, F.lit(r"\p{Lu}")) / size),
        _binned("symbols", 2 * F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]")) / size),
        _binned("digits", 2 * F.regexp_count(text, F.lit(r"\p{N}")) / size),
        _binned("distinct", F.size(distinct) / count),
        _binned("repeated_lines", 1 - F.size(F.array_distinct(lines)) / F.size(lines)),
        _binned("word_length", size / count / 24),
        _binned("length", F.log2(size + 1) / 20, 20))
    return F.concat(distinct, *[_prefixes(distinct, n) for n in PREFIXES], style)


@dataclass(frozen=True)
class Head:
    """One trained head; ``vocabulary`` turns features into vectors. ``model`` is None where labels show one class only."""

    name: str
    rate: float
    model: object
    vocabulary: object = None


def _listed(docs: DataFrame, tokens: str, found: str, text: str) -> DataFrame:
    """Adds the features and the words of ``text``."""
    distinct, = fresh(docs, "__distinct")
    # One step each: what several later expressions use is computed once.
    worded = docs.withColumn(found, words(F.coalesce(F.col(text), F.lit(""))))
    worded = worded.withColumn(distinct, F.array_distinct(found))
    return worded.withColumn(tokens, features(
        F.coalesce(F.col(text), F.lit("")), F.col(found), F.col(distinct))).drop(distinct)


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> list[Head]:
    """Fit both heads on at most ``most`` labelled documents."""
    order = F.xxhash64("doc_id")
    named = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(h).alias(h) for h in HEADS])
    sample = named.orderBy(order, "doc_id").limit(most)
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # ``most`` rows of three numbers
    # A repeated id meets map-side, so that no id sends more than a row per task.
    joined = joined.groupBy("doc_id", *HEADS).agg(F.min("text").alias("text"))
    # Every round adds up a vector per partition; the bounded sample needs few.
    rows = _listed(joined, "tokens", "__words", "text").select(
        F.array_distinct("tokens").alias("tokens"), *HEADS).repartition(PARTS).persist()
    if rows.isEmpty():
        rows.unpersist()
        return [Head(name, 1.0 if name == "quality" else 0.0, None) for name in HEADS]
    heads = []
    for name in HEADS:
        known = rows.where(F.col(name).isNotNull()).select("tokens", F.col(name).cast("double").alias("label"))
        n, positive = known.agg(F.count(F.lit(1)), F.sum("label")).first()
        if not n or positive in (0, n):
            rate = (positive / n) if n else (1.0 if name == "quality" else 0.0)
            heads.append(Head(name, rate, None))
            continue
        heads.append(Head(name, positive / n, *_fit(known, n, positive / n)))
    rows.unpersist()
    return heads


def missed(residuals: DataFrame, n: int, most: int) -> list[str]:
    """Features of the steepest gradients above the penalty; ``residuals`` has tokens and chance minus label (off)."""
    slopes = residuals.select(F.explode("tokens").alias("token"), "off").groupBy("token").agg(
        F.count(F.lit(1)).alias("times"), F.abs(F.sum("off") / n).alias("slope"))
    steep = slopes.where((F.col("times") >= LEAST_SHARE * n) & (F.col("slope") > SLACK * PENALTY))
    return [r[0] for r in steep.orderBy(F.desc("slope"), "token").limit(most).select("token").collect()]


def _fit(known: DataFrame, n: int, rate: float):
    """Model and vocabulary of one head: the optimum over all features, fitted on those that matter for it."""
    used = missed(known.select("tokens", (F.lit(rate) - F.col("label")).alias("off")), n, STEP) or ["\x01length=0"]
    while True:
        vocabulary = CountVectorizerModel.from_vocabulary(used, "tokens", "features").setBinary(True)
        vectors = vocabulary.transform(known).persist()
        model = LogisticRegression(maxIter=ROUNDS, regParam=PENALTY, elasticNetParam=1.0,
                                   standardization=False).fit(vectors.select("features", "label"))
        off = model.transform(vectors).select("tokens", (vector_to_array("probability")[1] - F.col("label")).alias("off"))
        inside = set(used)
        new = [t for t in missed(off, n, STEP + len(used)) if t not in inside][:STEP]
        vectors.unpersist()
        if not new:
            return model, vocabulary
        used = used + new


def _log_odds(p: Column) -> Column:
    safe = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(safe / (1 - safe))


def _chance(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def evidence(docs: DataFrame, heads: list[Head], text: str = "text") -> DataFrame:
    """Adds ``{head}_evidence``, the log-likelihood ratio of the document alone, and ``worded``."""
    out = _listed(docs, "__tokens", "__words", text).withColumn("worded", F.size("__words") > 0).drop("__words")
    for head in heads:
        if head.model is None:
            out = out.withColumn(f"{head.name}_evidence", F.lit(0.0))
            continue
        out = head.vocabulary.copy().setInputCol("__tokens").setOutputCol("__features").transform(out)
        model = head.model.copy()
        model.setFeaturesCol("__features").setRawPredictionCol("__raw").setProbabilityCol("").setPredictionCol("")
        prior = math.log(head.rate / (1 - head.rate))
        out = model.transform(out).withColumn(f"{head.name}_evidence", vector_to_array("__raw")[1] - prior).drop(
            "__raw", "__features")
    return out.drop("__tokens")


HOST, PATH = ("source",), ("source", "lang")


def _strength(n: str, k: str, prior: Column) -> Column:
    """Aggregate over sites: Beta strength from the variance of site rates beyond chance."""
    rate, chance = F.col(k) / F.col(n), prior * (1 - prior)
    spread = F.sum(F.col(n) * (rate - prior) ** 2)
    expected = F.sum(chance)
    docs_ = F.sum(F.col(n))
    between = F.greatest((spread - expected) / docs_, F.lit(0.0))
    inner = F.sum(F.col(n) * chance) / docs_
    m = F.when(between > 0, inner / between - 1).otherwise(F.lit(STRONGEST))
    return F.least(F.greatest(m, F.lit(WEAKEST)), F.lit(STRONGEST))


def site_rates(scored: DataFrame, heads: list[Head]) -> DataFrame:
    """source, lang, n, and per head k (votes), host rate and the strength of the path prior."""
    votes = [F.sum(_chance(F.col(f"{h.name}_evidence") + _log_odds(F.lit(h.rate)))).alias(f"{h.name}_k") for h in heads]
    paths = cut(scored.groupBy(*PATH).agg(F.count(F.lit(1)).cast("double").alias("n"), *votes))
    hosts = paths.groupBy(*HOST).agg(F.sum("n").alias("host_n"), *[
        F.sum(f"{h.name}_k").alias(f"{h.name}_host_k") for h in heads])
    total = hosts.agg(F.sum("host_n"), *[F.sum(f"{h.name}_host_k") for h in heads]).first()
    rates = {h.name: (total[i + 1] / total[0] if total[0] else h.rate) for i, h in enumerate(heads)}
    strength = hosts.agg(F.lit(1), *[
        _strength("host_n", f"{h.name}_host_k", F.lit(rates[h.name])) for h in heads]).first()
    for i, h in enumerate(heads):
        m = strength[i + 1] or STRONGEST
        hosts = hosts.withColumn(f"{h.name}_host", (F.col(f"{h.name}_host_k") + m * rates[h.name]) / (F.col("host_n") + m))
    hosts = hosts.select(F.col("source").alias("__source"), *[f"{h.name}_host" for h in heads])
    nested = cut(paths.join(hosts, F.col("source").eqNullSafe(F.col("__source"))).drop("__source"))
    strength = nested.agg(F.lit(1), *[
        _strength("n", f"{h.name}_k", F.col(f"{h.name}_host")) for h in heads]).first()
    return nested.withColumns({f"{h.name}_m": F.lit(strength[i + 1] or STRONGEST) for i, h in enumerate(heads)})


def combine(scored: DataFrame, sites: DataFrame, heads: list[Head]) -> DataFrame:
    """Adds ``{head}_site`` (the path's rate without this document), ``{head}_score`` and ``keep``."""
    named = sites.withColumnsRenamed({"source": "__s", "lang": "__l"})
    out = scored.join(named, F.col("source").eqNullSafe(F.col("__s")) & F.col("lang").eqNullSafe(F.col("__l")), "left")
    for h in heads:
        own = _chance(F.col(f"{h.name}_evidence") + _log_odds(F.lit(h.rate)))
        m = F.col(f"{h.name}_m")
        site = (F.greatest(F.col(f"{h.name}_k") - own, F.lit(0.0)) + m * F.col(f"{h.name}_host")) / (F.col("n") - 1 + m)
        out = out.withColumn(f"{h.name}_site", site).withColumn(
            f"{h.name}_score", _chance(F.col(f"{h.name}_evidence") + _log_odds(F.col(f"{h.name}_site"))))
    out = out.withColumn("quality_score", F.when(F.col("worded"), F.col("quality_score")).otherwise(0.0))
    return out.withColumn("keep", (F.col("quality_score") >= 0.5) & (F.col("toxic_score") < 0.5))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores and decision of every document."""
    heads = train(docs, labels)
    scored = cut(evidence(docs.select("doc_id", "source", "lang", "text"), heads).drop("text"))
    judged = combine(scored, site_rates(scored, heads), heads)
    return judged.select("doc_id", "quality_evidence", "quality_site", "quality_score", "toxic_evidence", "toxic_site",
                         "toxic_score", "keep")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the classifier keeps, all their columns unchanged.

    The evidence is computed once and stored beside the documents in the shared folder, for the sites and the decision.
    """
    names = [f"__c{i}" for i in range(len(docs.columns))]
    wanted = ("doc_id", "source", "lang", "text")
    given = docs.toDF(*names).withColumnsRenamed({n: c for n, c in zip(names, docs.columns) if c in wanted})
    heads = train(given, labels)
    scored = settle(evidence(given, heads))
    judged = combine(scored, site_rates(scored, heads), heads).where("keep")
    return judged.select(*[F.col(c if c in wanted else n).alias(c) for n, c in zip(names, docs.columns)])
