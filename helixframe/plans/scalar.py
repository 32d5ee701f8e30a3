"""Queries of the scalar functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import chemistry as chem
from helixframe.functions import protein as prot
from helixframe.functions import sequence as sq
from helixframe.functions.tables import ATOMIC_WEIGHT, CODON_AMINO, HELIX, HYDROPATHY, MONOISOTOPIC, RESIDUE_MASS, SHEET, TURN, WATER_MASS
from helixframe.operators.structure import helix_atoms
from helixframe.plans import views
from helixframe.plans.views import sql

Query = Callable[[SparkSession, str], DataFrame]


def over(view: Query, columns: Callable[[], dict[str, Column]]) -> Query:
    """``columns`` are made when the query is, as expressions need a session."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return view(spark, sf_dir).select("doc_id", *(c.alias(n) for n, c in columns().items()))

    return query


def whole_text(columns: Callable[[], dict[str, Column]]) -> Query:
    return over(lambda spark, sf_dir: views.read(spark, sf_dir, "documents"), columns)


def text() -> Column:
    return F.coalesce("text", F.lit(""))


def seq() -> Column:
    return F.col("seq")


SQL_TEXT = f"translate(coalesce(text, ''), '{sq.LOWER}', '{sq.UPPER}')"


def codons_sql(s: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({s}, '[A-Z*-]{{3}}'), lambda c: CASE WHEN instr('TCAG', c[1]) > 0 AND instr('TCAG', c[2]) > 0 AND instr('TCAG', c[3]) > 0 "
        f"THEN substr('{CODON_AMINO}', (16 * instr('TCAG', c[1]) + 4 * instr('TCAG', c[2]) + instr('TCAG', c[3]) - 20)::BIGINT, 1) ELSE 'X' END), '')"
    )


def count_sql(letter: str, s: str = "seq") -> str:
    return f"(length({s}) - length(replace({s}, '{letter}', '')))"


def tm_sql(s: str) -> str:
    n, gc, at = f"length({s})", f"length(regexp_replace({s}, '[^GC]', '', 'g'))", f"length(regexp_replace({s}, '[^AT]', '', 'g'))"
    return f"CASE WHEN {n} = 0 THEN 0 WHEN {n} < 14 THEN 2.0::DOUBLE * {at} + 4.0 * {gc} ELSE 81.5::DOUBLE + 0.41::DOUBLE * ({gc} * 100.0::DOUBLE / {n}) - 675.0::DOUBLE / {n} END"


def weighted_sql(scale: dict[str, float]) -> str:
    return "(" + " + ".join(f"{count_sql(r)} * {v}::DOUBLE" for r, v in scale.items()) + ")"


def rna_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = views.text_dna(spark, sf_dir).select("doc_id", "seq", sq.longest_m_segment(sq.translate_codons(seq())).alias("orf"), sq.poly_a_tail(seq()).alias("tail"))
    kind, confidence = sq.rna_class(F.length("seq"), F.col("orf"), F.col("tail"))
    return measured.select("doc_id", kind.alias("rna_class"), confidence.alias("confidence"), F.col("orf").alias("longest_orf"), F.col("tail").alias("poly_a"))


def dna_helix_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return helix_atoms(views.text_dna(spark, sf_dir))


def seq_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = views.text_protein(spark, sf_dir).select("doc_id", F.explode(F.split("seq", "")).alias("symbol")).where("symbol <> ''")
    return symbols.groupBy("doc_id", "symbol").agg(F.count("*").alias("n"))


#: A sum formula for each part: made of its key, so that all elements and counts occur.
FORMULA = "concat('C', cast(p_partkey % 30 + 1 as string), 'H', cast(p_partkey % 50 + 1 as string), CASE WHEN p_partkey % 3 = 0 THEN 'N' ELSE '' END, 'O', cast(p_size % 9 + 1 as string), CASE WHEN p_partkey % 5 = 0 THEN 'NaCl' WHEN p_partkey % 7 = 0 THEN 'Fe2Xx3' ELSE 'P' END)"
FORMULA_SQL = f"SELECT p_partkey, p_name, p_brand, p_type, {FORMULA} AS formula FROM part"


def metabolites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "part").selectExpr("p_partkey", "p_name", "p_brand", "p_type", f"{FORMULA} AS formula")


def formula_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("formula")
    return metabolites(spark, sf_dir).select("p_partkey", "formula", F.round(chem.formula_mass(f), 6).alias("monoisotopic"), F.round(chem.formula_mass(f, False), 6).alias("average"), chem.formula_known(f).alias("known"))


def _mass_case(values: dict[str, float]) -> str:
    return "CASE a[1] " + " ".join(f"WHEN '{e}' THEN {m}::DOUBLE" for e, m in values.items()) + " ELSE 0 END"


ATOMS_SQL = "list_transform(regexp_extract_all(formula, '[A-Z][a-z]?[0-9]*'), lambda t: [regexp_extract(t, '[A-Za-z]+'), coalesce(nullif(regexp_extract(t, '[0-9]+'), ''), '1')])"
FORMULA_MASS_SQL = f"""WITH m AS ({FORMULA_SQL}), a AS (SELECT p_partkey, formula, unnest({ATOMS_SQL}) AS a FROM m)
SELECT p_partkey, formula, round(sum(a[2]::INT * {_mass_case(MONOISOTOPIC)}), 6) AS monoisotopic, round(sum(a[2]::INT * {_mass_case(ATOMIC_WEIGHT)}), 6) AS average,
bool_and(list_contains({list(MONOISOTOPIC)}, a[1])) AS known FROM a GROUP BY p_partkey, formula"""

MEANS = {"helix": HELIX, "sheet": SHEET, "turn": TURN}
QUERIES: dict[str, Query] = {
    "seq_sanitize": whole_text(lambda: dict(sanitized=sq.sanitize(text()))),
    "seq_detect_type": whole_text(lambda: dict(seq_type=sq.detect_type(sq.sanitize(text())))),
    "seq_complement": over(views.text_dna, lambda: dict(dna=sq.complement(seq()), rna=sq.complement(seq(), True))),
    "seq_revcomp": over(views.text_dna, lambda: dict(revcomp=sq.reverse_complement(seq()))),
    "seq_gc_at": over(views.text_dna, lambda: dict(gc=F.round(sq.gc_content(seq()), 6), at=F.round(sq.at_content(seq()), 6))),
    "seq_composition": seq_composition,
    "seq_translate": over(views.text_dna, lambda: dict(protein=sq.translate_codons(seq()))),
    "seq_transcribe": over(views.text_dna, lambda: dict(coding=sq.transcribe_coding(seq()), template=sq.transcribe_template(seq()))),
    "kmer_count": over(views.text_dna, lambda: dict(n_kmers=F.size(sq.kmers(seq(), 6)), n_distinct=F.size(F.array_distinct(sq.kmers(seq(), 6))))),
    "polya_tail": over(views.text_dna, lambda: dict(tail=sq.poly_a_tail(seq()))),
    "rna_classify": rna_classify,
    "protein_mw": over(views.text_protein, lambda: dict(mw=F.round(prot.molecular_weight(seq()), 3))),
    "protein_gravy": over(views.text_protein, lambda: dict(gravy=F.round(prot.gravy(seq()), 6))),
    "protein_aliphatic": over(views.text_protein, lambda: dict(aliphatic=F.round(prot.aliphatic_index(seq()), 6))),
    "protein_extinction": over(views.text_protein, lambda: dict(extinction=prot.extinction_coefficient(seq()).cast("long"))),
    "protein_ss_propensity": over(views.text_protein, lambda: dict(**{n: F.round(prot.mean_of(seq(), s, 1.0), 6) for n, s in MEANS.items()})),
    "protein_pi": over(views.text_protein, lambda: dict(pi=F.round(prot.isoelectric_point(seq()), 6))),
    "primer_tm": over(views.text_dna, lambda: dict(tm_short=F.round(sq.melting_temperature(F.substring(seq(), 1, 12)), 6), tm_long=F.round(sq.melting_temperature(seq()), 6))),
    "homopolymer_max": over(views.text_dna, lambda: dict(longest=sq.longest_homopolymer(seq()))),
    "stability_report": over(views.text_dna, lambda: dict(tm=F.round(sq.stability_temperature(seq()), 6), assessment=sq.thermal_stability(sq.gc_content(seq())), repeat_note=sq.longest_homopolymer(seq()) >= 6)),
    "dna_helix_atoms": dna_helix_atoms,
    "formula_mass": formula_mass,
}

SQL = {
    "seq_sanitize": f"SELECT doc_id, regexp_replace({SQL_TEXT}, '[^A-Z*-]', '', 'g') AS sanitized FROM documents",
    "seq_detect_type": f"SELECT doc_id, CASE WHEN s = '' THEN 'unknown' WHEN regexp_full_match(s, '[ACGTUN-]+') THEN CASE WHEN {count_sql('U', 's')} > {count_sql('T', 's')} THEN 'rna' ELSE 'dna' END ELSE 'protein' END AS seq_type FROM (SELECT doc_id, regexp_replace({SQL_TEXT}, '[^A-Z*-]', '', 'g') AS s FROM documents)",
    "seq_complement": sql("text_dna", "SELECT doc_id, translate(seq, 'ACGT', 'TGCA') AS dna, translate(seq, 'ACGTU', 'UGCAA') AS rna FROM v"),
    "seq_revcomp": sql("text_dna", "SELECT doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS revcomp FROM v"),
    "seq_gc_at": sql("text_dna", "SELECT doc_id, round(CASE WHEN seq = '' THEN 0 ELSE length(regexp_replace(seq, '[^GC]', '', 'g')) * 100.0::DOUBLE / length(seq) END, 6) AS gc, round(CASE WHEN seq = '' THEN 0 ELSE length(regexp_replace(seq, '[^ATU]', '', 'g')) * 100.0::DOUBLE / length(seq) END, 6) AS at FROM v"),
    "seq_composition": sql("text_protein", "SELECT doc_id, symbol, count(*) AS n FROM (SELECT doc_id, unnest(string_split(seq, '')) AS symbol FROM v) WHERE symbol <> '' GROUP BY ALL"),
    "seq_translate": sql("text_dna", f"SELECT doc_id, {codons_sql('seq')} AS protein FROM v"),
    "seq_transcribe": sql("text_dna", "SELECT doc_id, replace(seq, 'T', 'U') AS coding, replace(reverse(translate(seq, 'ACGT', 'TGCA')), 'T', 'U') AS template FROM v"),
    "kmer_count": sql("text_dna", "SELECT doc_id, greatest(length(seq) - 5, 0)::INT AS n_kmers, len(list_distinct(list_transform(range(1, greatest(length(seq) - 4, 1)), lambda i: substr(seq, i, 6))))::INT AS n_distinct FROM v"),
    "polya_tail": sql("text_dna", "SELECT doc_id, (length(seq) - length(rtrim(seq, 'A')))::INT AS tail FROM v"),
    "rna_classify": sql(
        "text_dna",
        f""", p AS (SELECT doc_id, length(seq) AS n, (length(seq) - length(rtrim(seq, 'A')))::INT AS poly_a,
        list_max(list_transform(string_split({codons_sql('seq')}, '*'), lambda x: CASE WHEN instr(x, 'M') > 0 THEN length(x) - instr(x, 'M') + 1 ELSE 0 END))::INT AS longest_orf FROM v)
        SELECT doc_id, longest_orf, poly_a,
        CASE WHEN n BETWEEN 18 AND 26 THEN 'miRNA' WHEN n BETWEEN 60 AND 100 THEN 'tRNA' WHEN n BETWEEN 100 AND 135 OR n BETWEEN 1400 AND 1650 OR n BETWEEN 2700 AND 3100 THEN 'rRNA' WHEN n > 200 AND longest_orf >= 30 THEN 'mRNA' WHEN n > 200 THEN 'lncRNA' WHEN n BETWEEN 20 AND 30 AND longest_orf < 30 THEN 'siRNA' ELSE 'unknown' END AS rna_class,
        CASE WHEN n BETWEEN 18 AND 26 THEN 55 WHEN n BETWEEN 60 AND 100 THEN 40 WHEN n BETWEEN 100 AND 135 OR n BETWEEN 1400 AND 1650 OR n BETWEEN 2700 AND 3100 THEN 38 WHEN n > 200 AND longest_orf >= 30 THEN CASE WHEN poly_a >= 10 THEN 75 ELSE 55 END WHEN n > 200 THEN 35 WHEN n BETWEEN 20 AND 30 AND longest_orf < 30 THEN 25 ELSE 15 END AS confidence FROM p""",
    ),
    "protein_mw": sql("text_protein", f"SELECT doc_id, round(CASE WHEN seq = '' THEN 0 ELSE {WATER_MASS}::DOUBLE + {weighted_sql(RESIDUE_MASS)} END, 3) AS mw FROM v"),
    "protein_gravy": sql("text_protein", f"SELECT doc_id, round(CASE WHEN seq = '' THEN 0 ELSE {weighted_sql(HYDROPATHY)} / length(seq) END, 6) AS gravy FROM v"),
    "protein_aliphatic": sql("text_protein", f"SELECT doc_id, round(CASE WHEN seq = '' THEN 0 ELSE ({count_sql('A')} + 2.9::DOUBLE * {count_sql('V')} + 3.9::DOUBLE * ({count_sql('I')} + {count_sql('L')})) * 100.0 / length(seq) END, 6) AS aliphatic FROM v"),
    "protein_extinction": sql("text_protein", f"SELECT doc_id, 5500 * {count_sql('W')} + 1490 * {count_sql('Y')} + 125 * ({count_sql('C')} // 2) AS extinction FROM v"),
    "protein_ss_propensity": sql("text_protein", "SELECT doc_id, " + ", ".join(f"round(CASE WHEN seq = '' THEN 1 ELSE {weighted_sql(s)} / length(seq) END, 6) AS {n}" for n, s in MEANS.items()) + " FROM v"),
    "primer_tm": sql("text_dna", f"SELECT doc_id, round({tm_sql('substr(seq, 1, 12)')}, 6) AS tm_short, round({tm_sql('seq')}, 6) AS tm_long FROM v"),
    "homopolymer_max": sql("text_dna", "SELECT doc_id, coalesce(list_max(list_transform(regexp_extract_all(seq, 'A+|C+|G+|T+'), lambda r: length(r))), 0)::INT AS longest FROM v"),
    "stability_report": sql(
        "text_dna",
        """SELECT doc_id, CASE WHEN n > 0 THEN round(64.9::DOUBLE + 41 * (gc / 100 * n - 16.4::DOUBLE) / n, 6) END AS tm,
        CASE WHEN gc >= 60 THEN 'Thermally stable (GC-rich)' WHEN gc >= 40 THEN 'Moderate stability' ELSE 'Lower thermal stability (AT-rich)' END AS assessment, h >= 6 AS repeat_note
        FROM (SELECT doc_id, length(seq) AS n, CASE WHEN seq = '' THEN 0 ELSE length(regexp_replace(seq, '[^GC]', '', 'g')) * 100.0::DOUBLE / length(seq) END AS gc, coalesce(list_max(list_transform(regexp_extract_all(seq, 'A+|C+|G+|T+'), lambda r: length(r))), 0) AS h FROM v)""",
    ),
    "dna_helix_atoms": sql(
        "text_dna",
        """, b AS (SELECT doc_id, seq, unnest(range(0, least(length(seq), 120))) AS i FROM v), s AS (SELECT *, unnest([1, 2]) AS strand FROM b)
        SELECT doc_id, strand::INT AS strand, i::INT AS base_index, CASE WHEN strand = 1 THEN seq[i + 1] ELSE translate(seq[i + 1], 'ACGT', 'TGCA') END AS base,
        round(9 * cos(radians(34 * i + 180 * (strand - 1))), 6) AS x, round(9 * sin(radians(34 * i + 180 * (strand - 1))), 6) AS y, (3.0 * i)::DOUBLE AS z FROM s""",
    ),
    "formula_mass": FORMULA_MASS_SQL,
}
