"""The queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


import public_tokenizers  # noqa: E402

from tabwise.llm import (  # noqa: E402
    decontaminate,
    hard_negatives,
    mixing,
    near_dup,
    quality,
    secret_scan,
    sharding,
    suffix_dedup,
    token_ids,
    topk,
    vector_dup,
    warc,
    whitening,
)

WORDS = r"""
regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query("op1_benchmark_decontamination", f"""
WITH item AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(w), 10) AS width, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
        FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN text IS NULL THEN [] ELSE {WORDS} END AS w FROM documents),
pos AS (SELECT r, i, width, array_to_string(w[i:i + width - 1], ' ') AS g
        FROM d, (SELECT DISTINCT width FROM win) s, unnest(range(1, len(w) - width + 2)) AS t(i)),
hit AS (SELECT r, i, pos.width, item FROM pos JOIN win ON pos.width = win.width AND pos.g = win.g),
mark AS (SELECT r, count(DISTINCT p) AS n FROM hit, unnest(range(i, i + width)) AS t(p) GROUP BY r),
names AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(mark.n, 0) AS n_hit, coalesce(names.n, 0) AS n_items,
       sha256(coalesce(names.s, '')) AS items_sha256, mark.n IS NOT NULL AS contaminated
FROM d LEFT JOIN mark USING (r) LEFT JOIN names USING (r)""")
def op1_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words, hit words and items of every document against every benchmark item."""
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("spans")


@query("op2_source_mixing", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('a' || source, 'b') AS k,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, 'null')) AS t FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap,
             ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY k),
f AS (SELECT *, sum(cap) OVER o - cap AS before, sum(w) OVER o - w AS gone, sum(w) OVER () AS weights,
             1.5::DOUBLE * sum(source_size) OVER () AS budget, row_number() OVER o AS n
      FROM s WINDOW o AS (ORDER BY cap::DOUBLE / w, k)),
l AS (SELECT arg_min((budget - before::DOUBLE) / (weights - gone), n) AS level FROM f
      WHERE (budget - before::DOUBLE) / (weights - gone) <= cap::DOUBLE / w),
g AS (SELECT k, source_size, budget, least(cap::DOUBLE, coalesce(level, 'inf'::DOUBLE) * w) AS target FROM f, l),
q AS (SELECT r, k, size, t, source_size, target, budget,
             (sum(size) OVER (PARTITION BY k ORDER BY t, size, r))::BIGINT AS u FROM d JOIN g USING (k)),
c AS (SELECT q.*, c, CASE WHEN target > 0 THEN (u + c * source_size)::DOUBLE / target ELSE 0 END AS f
      FROM q, (VALUES (0), (1)) AS v(c)),
z AS (SELECT r, size, (sum(size) OVER (ORDER BY f, k, c, t, u, r)) <= budget AS fits FROM c)
SELECT doc_id, d.size, source_size, target, x.taken::BIGINT AS taken
FROM d JOIN g USING (k) JOIN (SELECT r, sum(CASE WHEN fits THEN size ELSE 0 END) AS taken FROM z GROUP BY r) x USING (r)""")
def op2_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words taken of every document in the mix."""
    return mixing.report(table(spark, folder, "documents"))


@query("op7_hilbert_sharding")
def op7_hilbert_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document along the curve."""
    return sharding.report(table(spark, folder, "documents"))


@query("op10_exact_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def op10_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best rows for every row whose id is divisible by 20."""
    vectors = table(spark, folder, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


@query("op6_warc_revisits", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, html, h, list_transform(range(0, 8), lambda k: ('0x' || h[5 * k + 1:5 * k + 5])::INT) AS parts
      FROM p),
d AS (SELECT page_id, h, strlen(html)::BIGINT AS payload_bytes, array_to_string(flatten(list_transform(parts, lambda v:
          list_transform([15, 10, 5, 0], lambda s: '{warc.BASE32}'[((v >> s) & 31) + 1]))), '') AS payload_digest,
          min(page_id) OVER (PARTITION BY h) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d""")
def op6_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    """The record of every page, as read back from the archives."""
    return warc.report(table(spark, folder, "pages"))


@query("op9_token_files")
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Place and checksum of every document in the token files."""
    return token_ids.report(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op3_secret_scan")
def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets by rule and by model in every document."""
    return secret_scan.report(table(spark, folder, "documents"))


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Scores and decision of every document."""
    return quality.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_minhash_near_dup", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
           FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i)
      WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON x = a.r JOIN n b ON y = b.r WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
c AS (WITH RECURSIVE reach(x, y) AS (SELECT r, r FROM d UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x)
      SELECT x, min(doc_id) AS component_id FROM reach JOIN d ON y = d.r GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(doc_id = component_id, false) AS kept
FROM d JOIN c ON c.x = d.r LEFT JOIN n USING (r)""")
def op8_minhash_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document."""
    return near_dup.report(table(spark, folder, "documents"))


@query("op5_suffix_array_dedup")
def op5_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes that every document loses, and the digest of the rest."""
    return suffix_dedup.report(table(spark, folder, "documents"))


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """The eight leading whitened components of every vector."""
    return whitening.whiten(table(spark, folder, "embeddings"))


@query("op12_embedding_near_dup", """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT r, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
      WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.r AS x, b.r AS y FROM u a JOIN u b ON a.label = b.label AND a.r <> b.r AND a.norm > 0 AND b.norm > 0
      AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x),
c AS (WITH RECURSIVE reach(x, y) AS (SELECT r, r FROM v UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x)
      SELECT x, min(vec_id) AS component_id FROM reach JOIN v ON y = v.r GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN c ON c.x = v.r LEFT JOIN n ON n.x = v.r""")
def op12_embedding_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every vector."""
    return vector_dup.report(table(spark, folder, "embeddings"))


@query("op13_hard_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS same,
             list_dot_product(a.e, c.e)::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other AS negative_id, positive_score,
       score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 10""")
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every anchor and positive, some labels having been moved."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(vectors, vectors.where("vec_id % 100 = 0"))
