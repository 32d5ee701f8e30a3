"""Queries of read quality, trimming, demultiplexing and collection statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.sequence import gc_content
from helixframe.operators import quality as q
from helixframe.operators import statistics as st
from helixframe.plans import views
from helixframe.plans.scalar import seq_composition
from helixframe.plans.views import sql


def barcodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(views.BARCODES, "idx int, sample string, barcode string")


def qc_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = q.quality_report(views.reads(spark, sf_dir))
    return r.select("doc_id", F.length("seq").alias("n"), *(F.round(c, 6).alias(c) for c in ("gc", "at", "n_percent", "mean_q", "q20", "q30")), "min_q", "max_q", "grade")


def qc_quality_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.quality_bins(views.reads(spark, sf_dir)).select("doc_id", "bin", F.round("mean_q", 6).alias("mean_q"))


def qc_grade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.quality_report(views.reads(spark, sf_dir)).groupBy("lang", "grade").agg(F.count("*").alias("n"))


def stats_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.describe(views.text_dna(spark, sf_dir), F.length("seq"), "lang")


def stats_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.describe(views.text_dna(spark, sf_dir), gc_content(F.col("seq")), "lang")


def shannon_simpson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.diversity(seq_composition(spark, sf_dir), "doc_id")


def n50_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.n50(views.text_dna(spark, sf_dir).select("lang", F.length("seq").cast("long").alias("length")), "lang")


def demux_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.demultiplex(views.reads(spark, sf_dir), barcodes(spark)).select("doc_id", "sample", "seq")


def demux_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.demultiplex(views.reads(spark, sf_dir), barcodes(spark)).groupBy("sample").agg(F.count("*").alias("n"))


def trim_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.trim(views.reads(spark, sf_dir), head=4, tail=4, least=0).select("doc_id", "seq", "bases_trimmed", "reason")


def trim_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.trim(views.reads(spark, sf_dir), adapter="ACGTACG", probe=7, least=0).select("doc_id", "seq", "discarded", "reason")


def trim_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.reads(spark, sf_dir).select("doc_id", q.window_cut(F.col("qual")).cast("int").alias("keep"))


def trim_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.trim(views.reads(spark, sf_dir), head=4, tail=4).select("doc_id", "seq", "bases_trimmed", "discarded", "reason")


def trim_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = q.trim(views.reads(spark, sf_dir), head=4, tail=4)
    return t.groupBy("lang").agg(F.count_if(~F.col("discarded")).alias("kept"), F.count_if("discarded").alias("discarded"), F.sum("bases_trimmed").cast("long").alias("bases_trimmed"))


def mott_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = views.reads(spark, sf_dir).select("doc_id", q.mott_interval(F.col("qual")).alias("m"))
    return cut.select("doc_id", F.col("m.start").cast("int").alias("start"), F.col("m.end").cast("int").alias("end"))


#: The sequencing adapter of nanopore libraries.
NANOPORE = "AATGTACTTCGTTCAGTTACGTATTGCT"


def ont_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nanopore: reads of 200 bases and a mean quality of 9 or more, the adapter and what follows cut off."""
    kept = q.quality_report(views.reads(spark, sf_dir)).where("length >= 200 and coalesce(mean_q, 100) >= 9")
    return kept.select("doc_id", F.substring(F.col("seq"), F.lit(1), q.adapter_cut(F.col("seq"), NANOPORE, 14)).alias("seq"))


def illumina_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demultiplex (one mismatch, unassigned reads go), then trim; discarded reads go."""
    assigned = q.demultiplex(views.reads(spark, sf_dir), barcodes(spark), keep_unassigned=False)
    return q.trim(assigned).where("not discarded").select("doc_id", "sample", "seq")


QUERIES = {f.__name__: f for f in (qc_report, qc_quality_bins, qc_grade_counts, stats_length, stats_gc, shannon_simpson, n50_by_lang, demux_assign, demux_counts, trim_hard, trim_adapter, trim_window, trim_pipeline, trim_summary, mott_trim, ont_filter, illumina_pipeline)}

_PCT = "CASE WHEN seq = '' THEN 0 ELSE length(regexp_replace(seq, '[^{}]', '', 'g')) * 100.0::DOUBLE / length(seq) END"
_MEAN = "list_sum(qual)::DOUBLE / nullif(len(qual), 0)"
_GRADE = f"CASE WHEN len(qual) = 0 THEN 'B' WHEN {_MEAN} >= 30 THEN 'A' WHEN {_MEAN} >= 20 THEN 'B' WHEN {_MEAN} >= 15 THEN 'C' ELSE 'D' END"
_BY_LANG = "SELECT lang, count(x) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(stddev_pop(x), 6) AS sd, round(min(x), 6) AS least, round(max(x), 6) AS greatest FROM (SELECT lang, {} AS x FROM v) GROUP BY lang"
_DEMUX = """, m AS (SELECT v.*, idx, sample, barcode FROM v LEFT JOIN barcodes ON (length(seq) >= 4 AND hamming(CASE WHEN length(seq) >= 4 THEN substr(seq, 1, 4) ELSE 'ACGT' END, barcode) <= 1) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY idx) = 1),
dm AS (SELECT doc_id, lang, coalesce(sample, '') AS sample, substr(seq, 1 + coalesce(length(barcode), 0)) AS seq, qual[1 + coalesce(length(barcode), 0):] AS qual FROM m)"""


def _cut_sql(q: str, n: str, least: int) -> str:
    return f"CASE WHEN {n} < 4 THEN CASE WHEN {n} > 0 AND list_sum({q}) >= {least} * {n} THEN {n} ELSE 0 END ELSE coalesce(list_min(list_filter(range(0, {n} - 3), lambda i: {q}[i + 1] + {q}[i + 2] + {q}[i + 3] + {q}[i + 4] < {least} * 4)), {n}) END"


def _trim_sql(source: str, adapter: str = "AGATCGGAAGAG", head: int = 0, least: int = 20, shortest: int = 20) -> str:
    """CTEs ending in t: the trimmed reads of ``source``."""
    hard = f"CASE WHEN length(seq) > {2 * head} THEN {{0}}[{head + 1}:length(seq) - {head}] ELSE {{0}} END"
    return f""", h AS (SELECT *, length(seq) AS before, length(seq) > {2 * head} AND {head} > 0 AS hard, {hard.format("seq")} AS s, {hard.format("qual")} AS q0 FROM {source}),
    a AS (SELECT *, CASE WHEN instr(s, '{adapter}') > 0 THEN instr(s, '{adapter}') - 1 ELSE length(s) END AS a FROM h), b AS (SELECT *, q0[1:a] AS q FROM a),
    k AS (SELECT *, {_cut_sql("q", "a", least)} AS keep FROM b),
    t AS (SELECT *, substr(s, 1, keep) AS cut, (before - keep)::INT AS bases_trimmed, keep < {shortest} AS discarded,
      concat_ws('+', CASE WHEN hard THEN 'hard' END, CASE WHEN a < length(s) THEN 'adapter' END, CASE WHEN keep < a THEN 'low_quality' END, CASE WHEN keep < {shortest} THEN 'too_short' END) AS reason FROM k)"""


SQL = {
    "qc_report": sql("reads", f"SELECT doc_id, length(seq)::INT AS n, round({_PCT.format('GC')}, 6) AS gc, round({_PCT.format('ATU')}, 6) AS at, 0.0::DOUBLE AS n_percent, round({_MEAN}, 6) AS mean_q, round(len(list_filter(qual, lambda x: x >= 20)) * 100.0::DOUBLE / nullif(len(qual), 0), 6) AS q20, round(len(list_filter(qual, lambda x: x >= 30)) * 100.0::DOUBLE / nullif(len(qual), 0), 6) AS q30, list_min(qual) AS min_q, list_max(qual) AS max_q, {_GRADE} AS grade FROM v"),
    "qc_quality_bins": sql("reads", "SELECT doc_id, bin::INT AS bin, round(avg(x), 6) AS mean_q FROM (SELECT doc_id, (generate_subscripts(qual, 1) - 1) // ceil(len(qual) / 20)::BIGINT AS bin, unnest(qual) AS x FROM v WHERE len(qual) > 0) GROUP BY ALL"),
    "qc_grade_counts": sql("reads", f"SELECT lang, {_GRADE} AS grade, count(*) AS n FROM v GROUP BY ALL"),
    "stats_length": sql("text_dna", _BY_LANG.format("length(seq)::DOUBLE")),
    "stats_gc": sql("text_dna", _BY_LANG.format(f"{_PCT.format('GC')}")),
    "shannon_simpson": sql("text_protein", ", c AS (SELECT doc_id, s, count(*) AS n FROM (SELECT doc_id, unnest(string_split(seq, '')) AS s FROM v) WHERE s <> '' GROUP BY ALL), p AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM c) SELECT doc_id, round(sum(-p * log2(p)), 6) AS shannon, round(1 - sum(p * p), 6) AS simpson FROM p GROUP BY doc_id"),
    "n50_by_lang": sql("text_dna", ", l AS (SELECT lang, length(seq) AS n, sum(length(seq)) OVER (PARTITION BY lang ORDER BY length(seq) DESC) AS r, sum(length(seq)) OVER (PARTITION BY lang) AS t FROM v) SELECT lang, max(n)::BIGINT AS n50, max(t)::BIGINT AS total FROM l WHERE r * 2 >= t GROUP BY lang"),
    "demux_assign": sql("reads", _DEMUX + " SELECT doc_id, sample, seq FROM dm", "barcodes"),
    "demux_counts": sql("reads", _DEMUX + " SELECT sample, count(*) AS n FROM dm GROUP BY sample", "barcodes"),
    "trim_hard": sql("reads", _trim_sql("v", head=4, least=0) + " SELECT doc_id, cut AS seq, bases_trimmed, reason FROM t"),
    "trim_adapter": sql("reads", _trim_sql("v", "ACGTACG", least=0) + " SELECT doc_id, cut AS seq, discarded, reason FROM t"),
    "trim_window": sql("reads", f"SELECT doc_id, ({_cut_sql('qual', 'len(qual)', 20)})::INT AS keep FROM v"),
    "trim_pipeline": sql("reads", _trim_sql("v", head=4) + " SELECT doc_id, cut AS seq, bases_trimmed, discarded, reason FROM t"),
    "trim_summary": sql("reads", _trim_sql("v", head=4) + " SELECT lang, count_if(NOT discarded)::BIGINT AS kept, count_if(discarded)::BIGINT AS discarded, sum(bases_trimmed)::BIGINT AS bases_trimmed FROM t GROUP BY lang"),
    "mott_trim": sql(
        "reads",
        """, e AS (SELECT doc_id, generate_subscripts(qual, 1) AS i, unnest(qual) - 20 AS x FROM v), p AS (SELECT doc_id, i, sum(x) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM e UNION ALL SELECT doc_id, 0, 0 FROM v),
        m AS (SELECT doc_id, i, s, min(s) OVER (PARTITION BY doc_id ORDER BY i) AS low FROM p), g AS (SELECT doc_id, max(s - low) AS gain FROM m GROUP BY doc_id),
        b AS (SELECT m.doc_id, gain, min(i) AS e, arg_min(low, i) AS low FROM m JOIN g ON m.doc_id = g.doc_id AND s - low = gain GROUP BY m.doc_id, gain)
        SELECT b.doc_id, CASE WHEN gain > 0 THEN (SELECT min(i) FROM p WHERE p.doc_id = b.doc_id AND p.s = b.low AND p.i < b.e) ELSE 0 END::INT AS start, CASE WHEN gain > 0 THEN e ELSE (SELECT len(qual) FROM v WHERE v.doc_id = b.doc_id) END::INT AS end FROM b""",
    ),
    "ont_filter": sql("reads", f"SELECT doc_id, CASE WHEN instr(seq, '{NANOPORE[:14]}') > 0 THEN substr(seq, 1, instr(seq, '{NANOPORE[:14]}') - 1) ELSE seq END AS seq FROM v WHERE length(seq) >= 200 AND {_MEAN} >= 9"),
    "illumina_pipeline": sql("reads", _DEMUX + _trim_sql("(SELECT * FROM dm WHERE sample <> '')") + " SELECT doc_id, sample, cut AS seq FROM t WHERE NOT discarded", "barcodes"),
}
