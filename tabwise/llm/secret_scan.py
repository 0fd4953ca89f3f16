"""Secret scan by two character Markov models, with DataFrame functions alone.

Rules name the secrets whose form is known: assignments, access keys, long hexadecimal strings. In what the rules leave of
a text two first-order Markov models compete, one of random strings and one of ordinary identifiers. Along every run of
``LEAST_RUN`` or more characters of ``ALPHABET`` the log-likelihood ratios are added up; the sum starts anew where it falls
to zero or by the threshold below its highest value. A stretch whose highest sum exceeds the threshold is a find, widened
to the separators around it. So a key inside a path or behind a name is judged by itself, and a run beside a rule's find
is judged as well. Runs below ``LEAST_RUN`` characters are too short for the sum to exceed chance and are not judged.

Both models are trained from labelled samples of the scanned table: what the rules found is random, shorter strings around
it are ordinary, as often as they occur, so that rates do not change with the size of the table. Digests of the row keys
in base 64 are labelled random as well, so that the model is defined where no rule matches. Every fifth document of the
sample is held out: the threshold is ``LEAST_ODDS``, or what the highest sums of the held-out ordinary strings stay below
but for a share of ``FALSE_SHARE``, if that is more.

Training reads at most ``TRAINING_DOCS`` documents with the smallest hash of their id, of rows that repeat an id the one
with the smallest text: a documented bound on labelled rows. Every text is scanned whole.

Defined results. Null and empty texts have no finds. Positions are code points, ends exclusive. Finds of the models never
overlap a rule's. Repeated rows are scanned each. A table without usable samples gives models that prefer neither side,
so only the rules find something. Other columns are ignored.

Scale. Scanning needs no shuffle: positions follow from the pieces between matches, and the models are two literals of
the size of the alphabet squared. Only their counts and the threshold reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (kind, pattern, group that must be long, its least length)
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs below the least length are dropped, so the pattern asks for it at once.
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
CODES = 128
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST_RUN = 8
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_RUN
TOKEN = r"[A-Za-z0-9+/_=-]+"
#: Lengths of the strings that are labelled ordinary.
ORDINARY = (3, 15)
TRAINING_DOCS = 5000
#: Least sum of a find, odds of a million to one, and the share of ordinary strings that may exceed the threshold.
LEAST_ODDS, FALSE_SHARE = math.log(1e6), 1e-4
#: Weight of the rates of character classes in those of a pair, and of what was never seen.
BACKOFF, SMOOTHING = 20.0, 0.5
SPANS = "array<struct<start:int,end:int,kind:int,name:string,match:string>>"
CUTS = "array<struct<from:int,to:int>>"


def _spans(text: Column, pattern: str, group: int, judge: Callable[[Column, Column], Column], kind: int, name: str) -> Column:
    """Spans inside all matches: ``judge`` gives those of a match and its group, counted from the start of the match.

    The k-th match starts after the pieces before it and the earlier matches.
    """
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    steps = F.zip_with(pieces, F.arrays_zip(matches.alias("m"), values.alias("v")), lambda p, x: F.struct(
        F.length(p).alias("gap"), x["m"].alias("match"),
        F.when(x["m"].isNotNull(), judge(x["m"], x["v"])).otherwise(F.array().cast(CUTS)).alias("cuts")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found"))

    def step(state, x):
        begin = state["at"] + x["gap"]
        end = begin + F.coalesce(F.length(x["match"]), F.lit(0))
        spans = F.transform(x["cuts"], lambda c: F.struct(
            (begin + c["from"]).alias("start"), (begin + c["to"]).alias("end"), F.lit(kind).alias("kind"),
            F.lit(name).alias("name"), F.substring(x["match"], c["from"] + 1, c["to"] - c["from"]).alias("match")))
        return F.struct(end.alias("at"), F.when(F.size(x["cuts"]) > 0, F.concat(state["found"], spans)).otherwise(
            state["found"]).alias("found"))

    found = F.aggregate(steps, start, step, lambda s: s["found"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPANS))


def _long(least: int) -> Callable[[Column, Column], Column]:
    """Judge that takes the whole match if its group is long enough."""
    return lambda match, value: F.when(F.length(value) >= least, F.array(F.struct(
        F.lit(0).alias("from"), F.length(match).alias("to")))).otherwise(F.array().cast(CUTS))


def rule_spans(text: Column) -> Column:
    """Spans of all rules, by start and then in the order of the rules."""
    return F.array_sort(F.concat(*[_spans(text, p, g, _long(n), k, name) for k, (name, p, g, n) in enumerate(RULES)]))


def without(text: Column, spans: Column) -> Column:
    """Text of the same length with spaces in place of sorted spans."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state, x):
        gap = F.greatest(x["start"] - state["at"], F.lit(0))
        end = F.greatest(x["end"], state["at"])
        return F.struct(end.alias("at"), F.array_append(state["parts"], F.concat(
            F.substring(text, state["at"] + 1, gap), F.repeat(F.lit(" "), end - state["at"] - gap))).alias("parts"))

    masked = F.aggregate(spans, start, step, lambda s: F.concat(
        F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, masked).otherwise(text)


def _letters(token: Column) -> Column:
    """Codes of the characters; 0 stands for the start of a string."""
    return F.transform(F.split(token, ""), lambda c: F.ascii(c))


def training_docs(docs: DataFrame, most: int = TRAINING_DOCS) -> DataFrame:
    """doc_id and text of the documents with the smallest hash of their id, one row per id."""
    order = F.xxhash64(F.col("doc_id"))
    last = docs.select(order.alias("h")).distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    near = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(order <= F.lit(last))
    return near.groupBy("doc_id").agg(F.min("text").alias("text"))


def labelled_strings(sample: DataFrame) -> DataFrame:
    """(random, token): distinct finds of the rules and digests against the words of the remaining text."""
    found = sample.select(F.explode(rule_spans(F.col("text"))).alias("s")).select(
        F.regexp_replace("s.match", r"^.*[\x20:=\x22']", "").alias("token"))
    digest = F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 256)
    digests = sample.select(F.base64(F.unhex(digest)).alias("token"))
    rest = F.col("text")
    for _, pattern, _, _ in RULES:
        rest = F.regexp_replace(rest, pattern, " ")
    ordinary = sample.select(F.explode(F.regexp_extract_all(rest, F.lit(TOKEN), F.lit(0))).alias("token")).where(
        F.length("token").between(*ORDINARY))
    return found.unionByName(digests).distinct().select(F.lit(True).alias("random"), "token").unionByName(
        ordinary.select(F.lit(False).alias("random"), "token"))


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratio of every pair of characters, row by row over ``n + 1`` states, and the least sum of a find."""

    ratios: list[float]
    threshold: float


def train(docs: DataFrame, most: int = TRAINING_DOCS) -> Model:
    """Fit both models and set the threshold on documents they have not seen."""
    sample = training_docs(docs, most).persist()
    held = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(5)) == 0
    model = Model(ratios(sample.where(~held)), LEAST_ODDS)
    ordinary = labelled_strings(sample.where(held)).where("NOT random")
    high = ordinary.agg(F.percentile_approx(top_sum(F.col("token"), model), 1 - FALSE_SHARE, 100_000)).first()[0]
    sample.unpersist()
    return Model(model.ratios, max(LEAST_ODDS, high or 0.0))


def ratios(sample: DataFrame) -> list[float]:
    letters = _letters(F.col("token"))
    pairs = labelled_strings(sample).select("random", letters.alias("b")).select(
        "random", F.explode(F.arrays_zip(F.concat(F.array(F.lit(0)), F.col("b")).alias("a"), F.col("b").alias("b"))).alias("p"))
    counted = pairs.where("p.b IS NOT NULL").groupBy("random", "p.a", "p.b").count().collect()  # alphabet squared at most
    place = {ord(c): i + 1 for i, c in enumerate(ALPHABET)}
    n = len(ALPHABET) + 1
    counts = {kind: [[0.0] * n for _ in range(n)] for kind in (True, False)}
    for kind, a, b, times in counted:
        counts[kind][place.get(a, 0)][place.get(b, 0)] += times
    if not any(r[0] for r in counted) or all(r[0] for r in counted):
        return [0.0] * (n * n)
    chance = {kind: _chances(table) for kind, table in counts.items()}
    return [math.log(chance[True][a][b] / chance[False][a][b]) for a in range(n) for b in range(n)]


def _kind(place: int) -> int:
    """Class of a character: start or unknown, capital, small letter, digit, symbol."""
    return 0 if place == 0 else 1 if place <= 26 else 2 if place <= 52 else 3 if place <= 62 else 4


def _chances(pairs: list[list[float]]) -> list[list[float]]:
    """Chance of each character after each, backed off to the chance of its class after the other's class.

    So a number is as ordinary as numbers are, however few of its pairs of digits the sample holds.
    """
    n = len(pairs)
    single = [sum(row[b] for row in pairs) + SMOOTHING for b in range(n)]
    classes = [[SMOOTHING] * 5 for _ in range(5)]
    for a in range(n):
        for b in range(n):
            classes[_kind(a)][_kind(b)] += pairs[a][b]
    whole = [sum(single[b] for b in range(n) if _kind(b) == k) for k in range(5)]
    expected = [[classes[j][_kind(b)] / sum(classes[j]) * single[b] / whole[_kind(b)] for b in range(n)] for j in range(5)]
    return [[(x + BACKOFF * p) / (sum(row) + BACKOFF) for x, p in zip(row, expected[_kind(a)])]
            for a, row in enumerate(pairs)]


def _table(model: Model) -> Column:
    """The ratios as an array over pairs of character codes."""
    place = {ord(c): i + 1 for i, c in enumerate(ALPHABET)} | {0: 0}
    n = len(ALPHABET) + 1
    wide = (model.ratios[place[a] * n + place[b]] if a in place and b in place else 0.0
            for a in range(CODES) for b in range(CODES))
    return F.split(F.lit(",".join(f"{x:.6f}" for x in wide)), ",").cast("array<double>")


def top_sum(token: Column, model: Model) -> Column:
    """Highest sum of ratios over all stretches of a string."""
    table = _table(model)
    start = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("top"))

    def step(s, c):
        code = F.ascii(c)
        total = F.greatest(s["sum"] + F.get(table, s["before"] * CODES + code), F.lit(0.0))
        return F.struct(code.alias("before"), total.alias("sum"), F.greatest(s["top"], total).alias("top"))

    return F.aggregate(F.split(token, ""), start, step, lambda s: s["top"])


def stretches(token: Column, model: Model) -> Column:
    """Spans of the stretches that exceed the threshold, widened to the separators ``/ _ = -`` around them."""
    state = "struct<sum:double,top:double,at:int,from:int,to:int,found:array<struct<from:int,to:int>>>"
    none = F.array().cast(CUTS)
    start = F.struct(F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0), F.lit(0), none).cast(state)

    def closed(s):
        return F.when(s["top"] > model.threshold, F.array_append(s["found"], F.struct(
            s["from"].alias("from"), s["to"].alias("to")))).otherwise(s["found"])

    def step(s, x):
        total, at = s["sum"] + x, s["at"] + 1
        over = (total <= 0) | (total < s["top"] - model.threshold)
        anew = F.struct(F.lit(0.0), F.lit(0.0), at, at, at, closed(s)).cast(state)
        on = F.struct(total, F.greatest(s["top"], total), at, s["from"], F.when(total > s["top"], at).otherwise(s["to"]),
                      s["found"]).cast(state)
        return F.when(over, anew).otherwise(on)

    def widened(c):
        inner = F.substring(token, c["from"] + 1, c["to"] - c["from"])
        begin = c["from"] + F.length(F.regexp_extract(inner, r"^[/_=-]*", 0))
        end = c["to"] - F.length(F.regexp_extract(inner, r"[/_=-]*$", 0))
        before = F.length(F.regexp_extract(F.substring(token, F.lit(1), begin), r"[^/_=-]*$", 0))
        after = F.length(F.regexp_extract(F.substring(token, end + 1, F.length(token)), r"^[^/_=-]*", 0))
        return F.struct((begin - before).alias("from"), (end + after).alias("to"))

    def merged(done, c):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.array_append(F.slice(done, 1, F.size(done) - 1), F.struct(
            last["from"].alias("from"), F.greatest(last["to"], c["to"]).alias("to")))
        return F.when((F.size(done) > 0) & (last["to"] > c["from"]), joined).otherwise(
            F.array_append(done, c))

    letters, table = _letters(token), _table(model)
    before = F.concat(F.array(F.lit(0)), F.slice(letters, 1, F.length(token) - 1))
    scores = F.zip_with(before, letters, lambda a, b: F.get(table, a * CODES + b))
    found = F.aggregate(scores, start, step, closed)
    # Neighbouring stretches of one part widen to the same part. Most strings are left by their highest sum alone.
    every = F.aggregate(F.transform(found, widened), none, merged)
    return F.when(top_sum(token, model) > model.threshold, every).otherwise(none)


def find(docs: DataFrame, keep: list[str], model: Model) -> DataFrame:
    """``keep`` columns, ``rules`` (spans of the rules) and ``random`` (spans of the models) of every document."""
    text = F.coalesce("text", F.lit(""))
    given = docs.select(*keep, text.alias("__text")).withColumn("rules", rule_spans(F.col("__text")))
    given = given.withColumn("__left", without(F.col("__text"), F.col("rules")))
    added = _spans(F.col("__left"), CANDIDATE, 0, lambda match, _: stretches(match, model), len(RULES), "random")
    return given.withColumn("random", added).drop("__text", "__left")


def _count(name: str) -> Column:
    return F.size(F.filter("rules", lambda s: s["name"] == name)).cast("long")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts and digest of the rules' finds, and all spans, per document."""
    found = find(docs.select("doc_id", "text"), ["doc_id"], train(docs))
    counts = [_count(name).alias(f"n_{name}") for name, *_ in RULES]
    return found.select(
        "doc_id", *counts, F.sha2(_listed(F.col("rules")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("rules", "random"))).alias("spans"))
