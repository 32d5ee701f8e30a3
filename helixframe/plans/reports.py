"""Queries of reports over whole sequences: proteins, collections, features, the workflow of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import protein as prot
from helixframe.functions import sequence as sq
from helixframe.functions.letters import letter_numbers
from helixframe.functions.tables import HELIX, HYDROPATHY, RESIDUE_MASS, RESIDUES, SHEET, TURN, WATER_MASS
from helixframe.operators import annotation as an
from helixframe.operators import library as lib
from helixframe.operators import sketches as sk
from helixframe.operators import statistics as st
from helixframe.operators import targets as tg
from helixframe.operators import variants as va
from helixframe.operators.folding import fold_rna
from helixframe.operators.primers import primer_pairs
from helixframe.operators.quality import quality_report
from helixframe.operators.similarity import identify
from helixframe.operators.structure import backbone
from helixframe.operators.workflow import Task, findings, run_tasks
from helixframe.plans import views
from helixframe.plans.analysis import _BLOCKS, _ORFS, aligned_pairs
from helixframe.plans.scalar import codons_sql, count_sql, weighted_sql
from helixframe.plans.views import sql

SEQ = "seq"


def protein_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col(SEQ)
    numbers = {"mw": prot.molecular_weight(s), "gravy": prot.gravy(s), "aliphatic": prot.aliphatic_index(s)}
    counts = {"cysteines": sq.count_of(s, "C"), "tryptophans": sq.count_of(s, "W"), "tyrosines": sq.count_of(s, "Y"), "extinction": prot.extinction_coefficient(s).cast("long")}
    own = views.read(spark, sf_dir, "documents").select("doc_id", prot.clean_protein(F.coalesce("text", F.lit(""))).alias(SEQ))
    return own.select("doc_id", F.length(s).alias("residues"), *(F.round(c, 3).alias(n) for n, c in numbers.items()), *(c.alias(n) for n, c in counts.items()))


def residue_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H, S and C for helix, sheet and coil, a letter for each residue."""
    return views.text_protein(spark, sf_dir).select("doc_id", prot.structure_letters(SEQ).alias("structure"))


def protein_backbone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backbone(views.text_protein(spark, sf_dir))


def merged_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.composition(views.text_dna(spark, sf_dir))


def collection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.collection_report(views.text_dna(spark, sf_dir), sq.gc_content(F.col(SEQ)))


def kmer_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates of distinct 11-mers by source and language and of all their combinations, merged from sketches."""
    own = views.read(spark, sf_dir, "documents").select("source", "lang", views.bases().alias(SEQ))
    return sk.kmer_cardinality(sk.kmer_sketches(own, ["source", "lang"]), ["source", "lang"], cube=True)


def count_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of each project; the documents' sources stand for projects."""
    return lib.count_by(views.read(spark, sf_dir, "documents"), "source")


def project_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the project ``src3``, sources standing for projects."""
    return lib.in_project(views.read(spark, sf_dir, "documents").withColumnRenamed("source", "project_id"), "src3").select("doc_id", "lang", "project_id")


def activity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hundred events: the bounded log."""
    return lib.last_entries(views.read(spark, sf_dir, "events"), "event_id").select("event_id", "event_type", "user_id")


def genome_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    orfs = an.find_orfs(views.dealt(views.text_dna(spark, sf_dir)), 150, 40)
    return lib.features(orfs, va.mutation_blocks(aligned_pairs(spark, sf_dir)))


def _protein() -> Column:
    return prot.clean_protein(sq.translate_codons(F.coalesce(SEQ, F.lit(""))))


def quality_task(df: DataFrame) -> DataFrame:
    graded = quality_report(df.withColumn("qual", F.lit(None).cast("array<int>")))
    return findings(graded, {"length": F.col("length"), "gc": F.col("gc"), "n_percent": F.col("n_percent"), "homopolymer": sq.longest_homopolymer(F.col(SEQ))}, {"grade": F.col("grade")})


def species_task(df: DataFrame) -> DataFrame:
    """The most similar other document of every one, by all pairs; one that shares no k-mer has no findings."""
    own = df.select(F.col("doc_id").alias("id"), SEQ)
    best = identify(own, own, top=2).where("query_id <> ref_id")
    first = best.groupBy(F.col("query_id").alias("doc_id")).agg(F.min_by(F.struct("ref_id", "similarity", "confidence"), "rank").alias("b"))
    return findings(first, {"reference": F.col("b.ref_id"), "similarity": F.col("b.similarity")}, {"confidence": F.col("b.confidence")})


def primer_task(df: DataFrame) -> DataFrame:
    """Documents without a pair have no findings."""
    pairs = primer_pairs(df, top=5).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("pair_score").alias("score"))
    return findings(pairs, {"primer_pairs": F.col("n"), "pair_score": F.col("score")})


def annotation_task(df: DataFrame) -> DataFrame:
    """Documents without a reading frame have no findings."""
    frames = an.find_orfs(df, 60, None).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("length").alias("longest"))
    return findings(frames, {"orfs": F.col("n"), "longest_orf": F.col("longest")})


def rna_task(df: DataFrame) -> DataFrame:
    kind, sure = sq.rna_class(F.length(SEQ), sq.longest_m_segment(sq.translate_codons(F.col(SEQ))), sq.poly_a_tail(F.col(SEQ)))
    folded = df.withColumn("fold", fold_rna(F.translate(SEQ, "T", "U")))
    return findings(folded, {"confidence": sure, "pairs": F.col("fold.pairs")}, {"rna_class": kind, "structure": F.col("fold.structure")})


def proteomics_task(df: DataFrame) -> DataFrame:
    counted = df.select("doc_id", prot.residue_counts(sq.translate_codons(F.coalesce(SEQ, F.lit("")))).alias("c"))
    return findings(counted, prot.counted_numbers(F.col("c")))


def targets_task(df: DataFrame) -> DataFrame:
    found = df.select("doc_id", _protein().alias("p")).select("doc_id", tg.membrane_regions("p").alias("m"), tg.target_count("p").alias("e"))
    return findings(found, {"membrane_regions": F.size("m"), "vaccine_targets": F.col("e")})


def statistics_task(df: DataFrame) -> DataFrame:
    """Diversity of the letters of each sequence, row by row."""
    s = F.col(SEQ)
    total = lambda f: F.aggregate("numbers", F.lit(0.0), lambda a, n: a + f(n / F.length(s)))
    own = df.select("doc_id", SEQ, letter_numbers(s).alias("numbers"))
    return findings(own, {"shannon": total(lambda p: -p * F.log2(p)), "simpson": 1 - total(lambda p: p * p)}, {"stability": sq.thermal_stability(sq.gc_content(s))})


#: The workflow's tasks by name; more may be added by a caller.
TASKS: dict[str, Task] = {"quality": quality_task, "species": species_task, "primer": primer_task, "annotation": annotation_task, "rna": rna_task, "proteomics": proteomics_task, "targets": targets_task, "statistics": statistics_task}
#: Those that SQL expresses, but for the isoelectric point.
IN_SQL = ["quality", "annotation", "proteomics", "statistics"]


def smart_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_tasks(views.dealt(views.text_dna(spark, sf_dir)), TASKS, list(TASKS))[0]


def workflow_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workflow's tasks that SQL expresses, and their findings."""
    return run_tasks(views.dealt(views.text_dna(spark, sf_dir)), TASKS, IN_SQL)[0].where("finding <> 'pi'")


def pipeline_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of the same run: a row for each task, with what was observed while its rows were written."""
    return run_tasks(views.dealt(views.text_dna(spark, sf_dir)), TASKS, IN_SQL)[1]


QUERIES = {f.__name__: f for f in (protein_report, residue_structure, protein_backbone, merged_composition, collection_report, count_by_source, project_scope, activity_log, genome_features, smart_workflow, workflow_findings, pipeline_log, kmer_cardinality)}


def _scale(values: dict[str, float]) -> str:
    return "CASE aa " + " ".join(f"WHEN '{r}' THEN {values[r]}" for r in RESIDUES) + " END"


_KINDS = f""", e AS (SELECT doc_id, generate_subscripts(string_split(seq, ''), 1) - 1 AS i, unnest(string_split(seq, '')) AS aa FROM v WHERE seq <> ''),
t AS (SELECT *, {_scale(HELIX)} AS h, {_scale(SHEET)} AS s, {_scale(TURN)} AS u FROM e), k AS (SELECT doc_id, i, aa, CASE WHEN h >= s AND h >= u THEN 'H' WHEN s >= h AND s >= u THEN 'S' ELSE 'C' END AS raw FROM t),
w AS (SELECT doc_id, i, aa, list(raw) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM k),
m AS (SELECT doc_id, i, aa, list_sort(list_transform(['H', 'S', 'C'], lambda x: {{'n': -len(list_filter(near, lambda y: y = x)), 'at': coalesce(list_position(near, x), 9), 'k': x}}))[1].k AS kind FROM w)"""
_GC = "CASE WHEN seq = '' THEN 0 ELSE length(regexp_replace(seq, '[^GC]', '', 'g')) * 100.0::DOUBLE / length(seq) END"
_FIVE = "round(avg({0}), 6) AS {0}_mean, round(quantile_cont({0}, 0.5), 6) AS {0}_median, round(stddev_pop({0}), 6) AS {0}_sd, round(min({0}), 6) AS {0}_least, round(max({0}), 6) AS {0}_greatest"
_WORKFLOW = sql(
    "text_dna",
    _ORFS.replace(">= 100", ">= 60")
    + f""", pr AS (SELECT doc_id, regexp_replace({codons_sql("seq")}, '[^{RESIDUES}]', '', 'g') AS seq FROM v),
    pn AS (SELECT doc_id, length(seq)::DOUBLE AS residues, CASE WHEN seq = '' THEN 0 ELSE {WATER_MASS}::DOUBLE + {weighted_sql(RESIDUE_MASS)} END::DOUBLE AS mw, CASE WHEN seq = '' THEN 0 ELSE {weighted_sql(HYDROPATHY)} / length(seq) END::DOUBLE AS gravy,
      CASE WHEN seq = '' THEN 0 ELSE ({count_sql("A")} + 2.9::DOUBLE * {count_sql("V")} + 3.9::DOUBLE * ({count_sql("I")} + {count_sql("L")})) * 100.0 / length(seq) END::DOUBLE AS aliphatic FROM pr),
    ql AS (SELECT doc_id, length(seq)::DOUBLE AS length, ({_GC})::DOUBLE AS gc, coalesce(list_max(list_transform(regexp_extract_all(seq, 'A+|C+|G+|T+'), lambda r: length(r))), 0)::DOUBLE AS homopolymer FROM v),
    sh AS (SELECT doc_id, unnest([{", ".join(f"{count_sql(b)}::DOUBLE / nullif(length(seq), 0)" for b in "ACGT")}]) AS p FROM v), sd AS (SELECT doc_id, coalesce(sum(CASE WHEN p > 0 THEN -p * log2(p) END), 0) AS shannon, coalesce(1 - sum(p * p), 1) AS simpson FROM sh GROUP BY doc_id),
    fd AS (SELECT doc_id, 'quality' AS task, unnest(['length', 'gc', 'n_percent', 'homopolymer']) AS finding, round(unnest([length, gc, 0, homopolymer])::DECIMAL(38, 12), 6)::DOUBLE AS number, NULL::VARCHAR AS text FROM ql
    UNION ALL SELECT doc_id, 'quality', 'grade', NULL, CASE WHEN length > 50 THEN 'A' ELSE 'B' END FROM ql
    UNION ALL SELECT doc_id, 'annotation', unnest(['orfs', 'longest_orf']), unnest([count(*)::DOUBLE, max(length)::DOUBLE]), NULL FROM q GROUP BY doc_id
    UNION ALL SELECT doc_id, 'proteomics', unnest(['residues', 'mw', 'gravy', 'aliphatic']), round(unnest([residues, mw, gravy, aliphatic])::DECIMAL(38, 12), 6)::DOUBLE, NULL FROM pn
    UNION ALL SELECT doc_id, 'statistics', unnest(['shannon', 'simpson']), round(unnest([shannon, simpson])::DECIMAL(38, 12), 6)::DOUBLE, NULL FROM sd
    UNION ALL SELECT doc_id, 'statistics', 'stability', NULL, CASE WHEN gc >= 60 THEN 'Thermally stable (GC-rich)' WHEN gc >= 40 THEN 'Moderate stability' ELSE 'Lower thermal stability (AT-rich)' END FROM ql) """,
)
SQL = {
    "workflow_findings": _WORKFLOW + "SELECT * FROM fd",
    "pipeline_log": _WORKFLOW + "SELECT task, 'done' AS state, count(*) + CASE task WHEN 'proteomics' THEN (SELECT count(*) FROM v) ELSE 0 END AS findings, count(number) + CASE task WHEN 'proteomics' THEN (SELECT count(*) FROM v) ELSE 0 END AS numbers, NULL::VARCHAR AS error FROM fd GROUP BY task",
    "protein_report": sql(
        "text_protein",
        f"SELECT doc_id, length(seq)::INT AS residues, round(CASE WHEN seq = '' THEN 0 ELSE {WATER_MASS}::DOUBLE + {weighted_sql(RESIDUE_MASS)} END, 3) AS mw, round(CASE WHEN seq = '' THEN 0 ELSE {weighted_sql(HYDROPATHY)} / length(seq) END, 3) AS gravy, "
        f"round(CASE WHEN seq = '' THEN 0 ELSE ({count_sql('A')} + 2.9::DOUBLE * {count_sql('V')} + 3.9::DOUBLE * ({count_sql('I')} + {count_sql('L')})) * 100.0 / length(seq) END, 3) AS aliphatic, "
        f"{count_sql('C')}::INT AS cysteines, {count_sql('W')}::INT AS tryptophans, {count_sql('Y')}::INT AS tyrosines, (5500 * {count_sql('W')} + 1490 * {count_sql('Y')} + 125 * ({count_sql('C')} // 2))::BIGINT AS extinction FROM v",
    ),
    "residue_structure": sql("text_protein", _KINDS + " SELECT v.doc_id, coalesce(string_agg(kind, '' ORDER BY i), '') AS structure FROM v LEFT JOIN m USING (doc_id) GROUP BY v.doc_id"),
    "protein_backbone": sql(
        "text_protein",
        _KINDS
        + """, o AS (SELECT *, coalesce(lag(kind) OVER p <> kind, true)::INT AS o FROM m WINDOW p AS (PARTITION BY doc_id ORDER BY i)), r AS (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
        a AS (SELECT *, radians(100.0::DOUBLE * (row_number() OVER (PARTITION BY doc_id, run ORDER BY i) - 1)) AS turn FROM r)
        SELECT doc_id, i::INT AS index, aa AS residue, CASE kind WHEN 'H' THEN 'helix' WHEN 'S' THEN 'sheet' ELSE 'coil' END AS kind,
        round(CASE kind WHEN 'H' THEN 2.3::DOUBLE * cos(turn) WHEN 'S' THEN CASE WHEN i % 2 = 0 THEN 1.6 ELSE -1.6 END ELSE 2.5::DOUBLE * sin(0.5::DOUBLE * i) END, 6) AS x,
        round(CASE kind WHEN 'H' THEN 2.3::DOUBLE * sin(turn) WHEN 'S' THEN 0 ELSE 2.0::DOUBLE * cos(0.7::DOUBLE * i) END, 6) AS y,
        round(sum(CASE kind WHEN 'H' THEN 1.5::DOUBLE WHEN 'S' THEN 3.2::DOUBLE ELSE 2.2::DOUBLE END) OVER (PARTITION BY doc_id ORDER BY i), 6) AS z FROM a""",
    ),
    "merged_composition": sql("text_dna", "SELECT symbol, count(*) AS n FROM (SELECT unnest(string_split(seq, '')) AS symbol FROM v) WHERE symbol <> '' GROUP BY ALL"),
    "collection_report": sql(
        "text_dna",
        f""", b AS (SELECT length(seq)::DOUBLE AS length, ({_GC})::DOUBLE AS gc FROM v), c AS (SELECT s, count(*) AS n FROM (SELECT unnest(string_split(seq, '')) AS s FROM v) WHERE s <> '' GROUP BY ALL), p AS (SELECT n / sum(n) OVER () AS p FROM c)
        SELECT count(*) AS n, {_FIVE.format("length")}, {_FIVE.format("gc")}, (SELECT round(sum(-p * log2(p)), 6) FROM p) AS shannon, (SELECT round(1 - sum(p * p), 6) FROM p) AS simpson FROM b""",
    ),
    "count_by_source": "SELECT source, count(*) AS n FROM documents GROUP BY ALL",
    "project_scope": "SELECT doc_id, lang, source AS project_id FROM documents WHERE coalesce(source, 'default') = 'src3'",
    "activity_log": "SELECT event_id, event_type, user_id FROM events ORDER BY ts DESC, event_id LIMIT 100",
    "genome_features": sql("text_dna", _ORFS.replace(">= 100", ">= 150").replace("rank <= 200", "rank <= 40") + " SELECT doc_id, 'orf' AS kind, forward_start AS start, forward_start + length AS end, strand FROM z UNION ALL SELECT * FROM (")
    + sql("text_dna", _BLOCKS + " SELECT id, CASE kind WHEN 'substitution' THEN 'snp' ELSE kind END, start, greatest(start + length(ref), start + 1)::INT, '+' FROM bl)"),
}
