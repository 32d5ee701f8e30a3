"""Queries of alignments, families, folding and primers over whole sequences, without SQL: the tests hold alignment, seeds,
multiple alignment, primers, assembly and the sides of LAMP sets against plain Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import families as fam
from helixframe.operators import variants as va
from helixframe.operators.alignment import align, seed_and_extend
from helixframe.operators.folding import fold_rna
from helixframe.operators.lamp import lamp_sets
from helixframe.operators.primers import candidates, primer_pairs
from helixframe.operators.scoring import Scoring
from helixframe.plans import views


#: A third of the sequence after a changed start, a gap of four, and the rest without its last two bases.
EDITED = "concat(translate(substr(seq, 5, 6), 'ACGT', 'GCTT'), substr(seq, 11, length(seq) div 3), substr(seq, 15 + length(seq) div 3, greatest(0, length(seq) - length(seq) div 3 - 16)))"


def edited_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, a, b): each document's sequence and the same with edits, dealt evenly to tasks."""
    return views.dealt(views.text_dna(spark, sf_dir)).selectExpr("doc_id", "seq AS a", f"{EDITED} AS b")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("identity", "similarity")})


def _aligned(mode: str, scoring: Scoring) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(edited_pairs(spark, sf_dir).select("doc_id", align(F.col("a"), F.col("b"), mode, scoring).alias("r")).select("doc_id", "r.*"))

    return query


def align_protein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's residues against the same without the last three and with I, D and R replaced, with BLOSUM62."""
    proteins = views.dealt(views.text_protein(spark, sf_dir)).selectExpr("doc_id", "seq AS a", "translate(reverse(substr(reverse(seq), 4)), 'IDR', 'VEK') AS b")
    return _rounded(proteins.select("doc_id", align(F.col("a"), F.col("b"), "global", Scoring(gap=-6, matrix="blosum62")).alias("r")).select("doc_id", "r.*"))


def align_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(edited_pairs(spark, sf_dir).select("doc_id", seed_and_extend(F.col("a"), F.col("b")).alias("r")).select("doc_id", "r.*"))


def mutation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Align, call blocks, classify codons: the blocks of each document's pair with impact, protein change and severity."""
    pairs = edited_pairs(spark, sf_dir).select(F.col("doc_id").alias("id"), align(F.col("a"), F.col("b")).alias("r"))
    return va.mutation_impacts(pairs.select("id", F.col("r.aligned_a").alias("ref_aligned"), F.col("r.aligned_b").alias("query_aligned")))


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of eight documents in the order of their ids."""
    return views.text_dna(spark, sf_dir).select(F.expr("doc_id div 8").alias("family_id"), F.col("doc_id").alias("idx"), "seq")


def _overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four overlapping reads of each document's bases, the third reversed: the first three fifths, the middle, the last, and a part of the first."""
    n = "length(seq)"
    parts = F.expr(f"array(substr(seq, 1, {n} * 3 div 5), substr(seq, 1 + {n} div 5, {n} * 3 div 5), reverse(translate(substr(seq, 1 + {n} * 2 div 5), 'ACGT', 'TGCA')), substr(seq, 1 + {n} div 10, {n} * 2 div 5))")
    return views.text_dna(spark, sf_dir).select(F.col("doc_id").alias("family_id"), F.posexplode(parts).alias("idx", "seq"))


def _subreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes of each document's first well: the sequence, and it with two kinds of errors; short texts have one pass."""
    own = views.text_dna(spark, sf_dir).where("seq <> ''")
    passes = F.expr("CASE WHEN length(seq) < 60 THEN array(seq) ELSE array(seq, concat(substr(seq, 1, 20), substr(seq, 22)), concat(substr(seq, 1, 40), 'G', substr(seq, 41))) END")
    return own.select(F.posexplode(passes).alias("n", "seq"), F.concat(F.lit("movie/"), F.col("doc_id").cast("string"), F.lit("/")).alias("well")).selectExpr("concat(well, n * 1000, '_', n * 1000 + length(seq)) AS name", "seq")


def rna_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.dealt(views.text_dna(spark, sf_dir)).select("doc_id", fold_rna(F.translate("seq", "T", "U")).alias("f")).select("doc_id", "f.*")


def primer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(views.dealt(views.text_dna(spark, sf_dir)).select("doc_id", "seq")).withColumns({c: F.round(c, 6) for c in ("gc", "tm", "score")})


def primer_pairs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return primer_pairs(views.dealt(views.text_dna(spark, sf_dir)).select("doc_id", "seq")).withColumns({c: F.round(c, 6) for c in ("f_tm", "r_tm", "f_score", "r_score", "pair_score")})


def lamp_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lamp_sets(views.dealt(views.text_dna(spark, sf_dir)).select("doc_id", "seq"))


AFFINE = Scoring(affine=True)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "align_global": _aligned("global", Scoring()),
    "align_global_affine": _aligned("global", AFFINE),
    "align_local": _aligned("local", Scoring()),
    "align_local_affine": _aligned("local", AFFINE),
    "align_glocal": _aligned("fit", Scoring()),
    "align_protein": align_protein,
    "align_seed_extend": align_seed_extend,
    "mutation_chain": mutation_chain,
    "msa_center": lambda spark, sf_dir: fam.alignments(_families(spark, sf_dir)),
    "tree_upgma": lambda spark, sf_dir: fam.trees(_families(spark, sf_dir), "upgma"),
    "tree_nj": lambda spark, sf_dir: fam.trees(_families(spark, sf_dir), "nj"),
    "assemble_contigs": lambda spark, sf_dir: fam.contigs(_overlapping(spark, sf_dir)),
    "msa_tree": lambda spark, sf_dir: fam.alignments(_families(spark, sf_dir), "tree"),
    "msa_profile": lambda spark, sf_dir: fam.alignments(_families(spark, sf_dir), "profile"),
    "tree_layout": lambda spark, sf_dir: fam.layouts(_families(spark, sf_dir), "upgma"),
    "ccs_consensus": lambda spark, sf_dir: fam.circular_consensus(_subreads(spark, sf_dir)),
    "lamp_design": lamp_design,
    "rna_fold": rna_fold,
    "primer_candidates": primer_candidates,
    "primer_pairs": primer_pairs_query,
}
SQL: dict[str, str] = {}
