"""The queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from helixframe.llm.centroid_clustering import cluster, clustering_sql
from helixframe.llm.common import read
from helixframe.llm.decontamination import DECONTAMINATION_SQL, contaminated
from helixframe.llm.embedding_dedup import near_duplicates as near_vectors
from helixframe.llm.html_text import extract
from helixframe.llm.importance_resampling import resample
from helixframe.llm.license_scan import license_sql, scan, templates_table
from helixframe.llm.line_dedup import dedup_lines
from helixframe.llm.packing import pack
from helixframe.llm.quality_classifier import classify
from helixframe.llm.quality_rules import apply_rules, rules_sql
from helixframe.llm.simhash import near_duplicates
from helixframe.llm.substring_dedup import dedup_substrings
from helixframe.llm.token_counts import count_tokens

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

LINE_DEDUP_SQL = """
WITH numbered AS (
  SELECT row_number() OVER () AS r, doc_id, text FROM documents
), lines AS (
  SELECT r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM numbered
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10
), marked AS (
  SELECT k.*, f.key IS NOT NULL AS dropped FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count_if(dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""


SUBSTRING_DEDUP_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), h AS (
  SELECT doc_id, unnest(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN i + 49 <= len(ws) THEN md5(array_to_string(ws[i:i + 49], ' ')) END)) AS w,
         unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d
), f AS (
  SELECT w, min(doc_id) AS first_doc FROM h WHERE w IS NOT NULL GROUP BY w
), m AS (
  SELECT h.doc_id, i, word, bool_or(coalesce(first_doc < h.doc_id, false)) OVER (PARTITION BY h.doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM h LEFT JOIN f ON h.w = f.w
), k AS (
  SELECT doc_id, count_if(gone)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


#: Components by taking the smallest id over the links again and again, as a recursive union of reachable ids.
EMBEDDING_DEDUP_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id)::BIGINT AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = e.vec_id
"""


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(read(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), WORD_BPE, end_id=1, capacity=4096)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents"), threshold=10)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is the folder in helixframe.token.cache, kept between runs; where that is unset, a new one for each run."""
    return count_tokens(read(spark, sf_dir, "documents"), BYTE_BPE, limit=512, cache=spark.conf.get("helixframe.token.cache", None))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read(spark, sf_dir, "documents"), window=50)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"), templates_table(spark))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read(spark, sf_dir, "embeddings"), k=8, rounds=10, seed="3")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), percent=25, least_words=20, seed="7")


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"), threshold=0.98)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_simhash_near_dedup, op3_quality_rules, op4_best_fit_packing, op5_html_extraction, op6_benchmark_decontamination, op7_line_dedup, op8_token_counts, op9_substring_dedup, op10_license_scan, op11_centroid_clustering, op12_importance_resampling, op13_embedding_near_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": rules_sql(), "op6_benchmark_decontamination": DECONTAMINATION_SQL, "op7_line_dedup": LINE_DEDUP_SQL, "op9_substring_dedup": SUBSTRING_DEDUP_SQL, "op10_license_scan": license_sql(), "op11_centroid_clustering": clustering_sql(), "op13_embedding_near_dedup": EMBEDDING_DEDUP_SQL}
