"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order that depends on ids alone, so reruns agree. A document's
virtual finish time is the words of its source up to its own end, divided by the source's target. All documents, and
after them their repeats, are sorted globally by finish time and taken until the next one would exceed the total budget:
at any point of that order every source has got the same share of its target, up to one document.

Targets. Sources are numbered by code point, null last; weights repeat along that order. ``SHARE`` of all words is
shared by weight; no target exceeds ``MOST`` times its source, and the excess goes to the others by weight until none is
above.

Defined results. Null and empty texts have size 0; they take no room and count as taken whenever their finish time lies
before the cut. A null source is a source of its own. A null doc_id is shuffled as the text "null". Repeated rows are
separate documents of the queue. An empty table gives an empty result. Other columns stay as they are.

Scale. Running sums over a source use a bucket of its shuffled order each, so a source with a third of all rows is
spread over ``BUCKETS`` windows; bucket totals are added as offsets. The global sort is a range partitioning of narrow
rows; only its cut point reaches the driver. Texts are shuffled once where the caller wants the mixed documents, and not
at all for sizes alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwise.llm.common import col, cut, ranked

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
# Parts of a source's shuffled order that are summed on their own: three hexadecimal digits of the shuffle key.
BUCKET_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Sorts as the source by code point, null last."""
    return F.coalesce(F.concat(F.lit("a"), source), F.lit("b"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(key, source_size) to (key, source_size, target), without collecting the sources."""
    numbered = ranked(sizes.select("key", "source_size"), [F.col("key")], "position")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights)).cast("int"))
    # Sources reach their cap in the order of cap over weight.
    weighed = numbered.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size")).withColumn(
        "level", F.col("cap") / F.col("weight"))
    filled = cut(ranked(weighed, [F.col("level"), F.col("key")], "order",
                        {"caps": "cap", "weights": "weight"}))
    all_words, all_weight = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = share * (all_words or 0)
    # The first source whose cap lies above what is left by weight; it and all later ones share the rest.
    rest = (F.lit(budget) - (F.col("caps") - F.col("cap"))) / (F.lit(all_weight) - (F.col("weights") - F.col("weight")))
    open_ = filled.where(rest <= F.col("level")).agg(F.min(F.struct("order", rest.alias("rest"))).alias("x")).first()[0]
    level = F.lit(open_["rest"] if open_ else float("inf"))
    return filled.select(
        "key", "source_size", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"))


def _queued(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """Add ``upto``: words of the source up to the document's end in shuffled order."""
    inside = Window.partitionBy("__key", "__bucket").orderBy("__tie", "__size").rowsBetween(
        Window.unboundedPreceding, 0)
    return rows.join(sums, ["__key", "__bucket"]).withColumn(
        "__upto", F.sum("__size").over(inside) + F.col("__earlier"))


def queue(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with their place in their source's queue, the sizes and targets of the sources).

    Adds ``__key``, ``__size``, ``__tie``, ``__upto``, ``__source_size`` and ``__target``.
    """
    tie = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    rows = docs.withColumns({
        "__key": source_key(F.col("source")), "__size": word_count(F.col("text")), "__tie": tie,
        "__bucket": F.substring(tie, 1, BUCKET_DIGITS)})
    parts = cut(rows.groupBy("__key", "__bucket").agg(F.sum("__size").alias("__part")))
    sizes = parts.groupBy("__key").agg(F.sum("__part").alias("source_size")).withColumnRenamed("__key", "key")
    goals = cut(targets(sizes))
    earlier = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.select("__key", "__bucket", F.coalesce(F.sum("__part").over(earlier), F.lit(0)).alias("__earlier"))
    sums = cut(sums.join(goals.select(
        F.col("key").alias("__key"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target")),
        "__key"))
    return _queued(rows, sums), goals


def _finish(copy: int) -> Column:
    """Virtual finish time of a document in the given pass over its source."""
    words = F.col("__upto") + F.lit(copy) * F.col("__source_size")
    return F.when(F.col("__target") > 0, words / F.col("__target")).otherwise(F.lit(0.0))


def _place(copy: int) -> Column:
    return F.struct(_finish(copy).alias("f"), F.col("__key").alias("k"), F.lit(copy).alias("c"),
                    F.col("__tie").alias("t"), F.col("__upto").alias("u"))


def mix(docs: DataFrame) -> DataFrame:
    """Documents with ``__taken``: how often each is taken (0 to ``MOST``), and its place in the queue."""
    given, goals = queue(docs)
    narrow = cut(given.select("__key", "__size", "__tie", "__upto", "__source_size", "__target"))
    budget = SHARE * (goals.agg(F.sum("source_size")).first()[0] or 0)
    copies = narrow.select("__size", F.explode(F.array(*[_place(c) for c in range(MOST)])).alias("p"))
    flat = copies.select("__size", "p.*")
    ordered = ranked(flat, [F.col(c) for c in "fkctu"], "rank", {"total": "__size"})
    last = ordered.where(F.col("total") <= F.lit(budget)).agg(F.max(F.struct(*"fkctu")).alias("x")).first()[0]
    if last is None:
        return given.withColumn("__taken", F.lit(0))
    end = F.struct(F.lit(last["f"]).alias("f"), F.lit(last["k"]).alias("k"), F.lit(last["c"]).alias("c"),
                   F.lit(last["t"]).alias("t"), F.lit(last["u"]).alias("u"))
    taken = sum(((_place(c) <= end).cast("int") for c in range(1, MOST)), (_place(0) <= end).cast("int"))
    return given.withColumn("__taken", taken)


def report(docs: DataFrame) -> DataFrame:
    """Words taken of every document, with its source's size and target."""
    return mix(docs.select("doc_id", "source", "text")).select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), (F.col("__taken") * F.col("__size")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every taken document as often as it is taken, all its columns unchanged."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    wanted = ("doc_id", "source", "text")
    given = docs.toDF(*names).withColumnsRenamed({
        n: c for n, c in zip(names, docs.columns) if c in wanted})
    taken = mix(given).where(F.col("__taken") > 0)
    return taken.withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("__taken")))).select(*[
        col(c if c in wanted else n).alias(c) for n, c in zip(names, docs.columns)])
