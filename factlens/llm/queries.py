"""The registered queries of this subpackage: thin uses of its operators over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embedding_dedup, license_scan, minhash_dedup, packing, pii, quality, substring_dedup, token_count, toxicity
from .common import table

#: A model file whose pieces and scores are the unigram vocabulary.
PIECES = os.environ.get("FACTLENS_PIECES", "/opt/tokenizers/piece_bpe_32k.model")

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    sha = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", "n_items", sha, "contaminated")


def op4_pack(spark: SparkSession, sf_dir: str, model: str = PIECES) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), token_count.load_pieces(model))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_tokens(spark: SparkSession, sf_dir: str, model: str = PIECES) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), token_count.load_pieces(model))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_minhash": op1_minhash,
    "op2_toxicity": op2_toxicity,
    "op3_decontaminate": op3_decontaminate,
    "op4_pack": op4_pack,
    "op5_substring": op5_substring,
    "op6_embeddings": op6_embeddings,
    "op7_tokens": op7_tokens,
    "op8_licenses": op8_licenses,
    "op9_pii": op9_pii,
    "op10_quality": op10_quality,
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SQL: dict[str, str] = {
    "op1_minhash": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS low FROM documents UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.id),
m AS (SELECT id, min(low) AS low FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.low AS component_id, m.low = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN m ON m.id = d.doc_id
""",
    "op3_decontaminate": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_ALNUM}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWERED}, '{_ALNUM}') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda k: array_to_string(w[k:k + least(len(w), 13) - 1], ' '))) AS g FROM i WHERE len(w) > 0),
l AS (SELECT DISTINCT m FROM g),
p AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS k, w FROM w, l WHERE len(w) >= m),
f AS (SELECT p.doc_id, p.k, p.m, g.item_id FROM (SELECT doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') AS g FROM p) p JOIN g ON p.m = g.m AND p.g = g.g),
h AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(k, k + m)) AS pos FROM f) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM f) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(t.x, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w.w) AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
""",
    "op5_substring": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM w WHERE len(w) >= 50)),
f AS (SELECT g, min(doc_id) AS low FROM g GROUP BY g),
p AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS pos FROM g JOIN f USING (g) WHERE f.low < doc_id),
a AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS x FROM w),
k AS (SELECT a.doc_id, count(*) FILTER (p.pos IS NOT NULL) AS n_removed, string_agg(a.x, ' ' ORDER BY a.pos) FILTER (p.pos IS NULL) AS kept FROM a LEFT JOIN p ON p.doc_id = a.doc_id AND p.pos = a.pos GROUP BY a.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
""",
    "op6_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda y: y IS NOT NULL AND isfinite(y)))),
u AS (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS n FROM v WHERE list_inner_product(x, x) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_inner_product(a.x, b.x) / (a.n * b.n) >= 0.9),
r AS (SELECT vec_id AS id, vec_id AS low FROM embeddings UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(low) AS low FROM r GROUP BY id),
c AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, m.low AS component_id, m.low = e.vec_id AS kept FROM embeddings e JOIN m ON m.id = e.vec_id LEFT JOIN c ON c.a = e.vec_id
""",
}
