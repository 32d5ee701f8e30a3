"""Queries of similarity, annotation, variants, targets, mass search and the library's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions import chemistry as chem
from helixframe.functions.tables import HYDROPATHY, HYDROPHILICITY, MONOISOTOPIC, RESIDUES
from helixframe.operators import annotation as an
from helixframe.operators import mass_search as ms
from helixframe.operators import similarity as sim
from helixframe.operators import targets as tg
from helixframe.operators import variants as va
from helixframe.operators.alignment import seed_diagonals
from helixframe.plans import views
from helixframe.plans.scalar import ATOMS_SQL, FORMULA_SQL, _mass_case, codons_sql, metabolites
from helixframe.plans.views import sql
from helixframe.sources.sequences import fasta_text

K = 11


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.text_dna(spark, sf_dir).select(F.col("doc_id").alias("id"), "seq")


def _identified(spark: SparkSession, sf_dir: str, top: int) -> DataFrame:
    """Queries are the documents whose id is divisible by 50, references all documents."""
    references = _references(spark, sf_dir)
    return sim.identify(references.where("id % 50 = 0"), references, K, top)


def species_identify_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identified(spark, sf_dir, 10).select("query_id", "ref_id", "shared", F.round("similarity", 6).alias("similarity"), "rank")


def species_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identified(spark, sf_dir, 10).groupBy("confidence").agg(F.count("*").alias("n"))


def domain_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of each query's best other reference: its ``source`` stands for the domain."""
    best = _identified(spark, sf_dir, 2).where("query_id <> ref_id")
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("r = 1")
    labels = views.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref_id"), F.col("source").alias("domain"))
    return best.join(labels, "ref_id").select("query_id", "ref_id", "domain")


def kmer_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity join of all documents: pairs of different k-mer sets that are 80 percent similar or more."""
    pairs, _ = sim.similar_sets(_references(spark, sf_dir), K, 80)
    return pairs.select("a", "b", "shared", F.round("similarity", 6).alias("similarity"))


def kmer_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each document in the similarity join, and with how many other classes it is similar."""
    return sim.similar_documents(_references(spark, sf_dir), K, 80)


def kmer_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each stated query (id divisible by 50) to all documents that share a k-mer; all others are at 1."""
    references = _references(spark, sf_dir)
    found = sim.shared_kmers(references.where("id % 50 = 0"), references, K)
    return found.where("query_id <> ref_id").select("query_id", "ref_id", F.round(1 - F.col("similarity") / 100, 6).alias("distance"))


def p_distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each stated query (id divisible by 50) to all sequences of its length, in long form."""
    every = views.text_dna(spark, sf_dir).select("doc_id", "seq", F.length("seq").alias("n")).where("n > 0")
    queries = every.where("doc_id % 50 = 0").select(F.col("doc_id").alias("i"), F.col("seq").alias("a"), "n")
    pairs = every.select(F.col("doc_id").alias("j"), F.col("seq").alias("b"), "n").join(queries, "n")
    differs = F.aggregate(F.zip_with(F.split("a", ""), F.split("b", ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, d: s + d)
    return pairs.where("i <> j").select("i", "j", F.round(differs / F.col("n"), 6).alias("distance"))


def seed_best_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = views.text_dna(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("seq").alias("a"), F.expr("concat('ACGTT', substring(seq, 9))").alias("b"))
    return seed_diagonals(views.dealt(pairs.withColumnRenamed("id", "doc_id")).withColumnRenamed("doc_id", "id"), K)


def orf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.find_orfs(views.dealt(views.text_dna(spark, sf_dir)))


def orf_best_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.best_frame(views.dealt(views.text_dna(spark, sf_dir)))


def orf_best_protein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.best_proteins(views.dealt(views.text_dna(spark, sf_dir)))


def gff3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.gff3_lines(an.find_orfs(views.text_dna(spark, sf_dir)))


def coverage_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.coverage(_intervals(spark, sf_dir), "l_orderkey")


def max_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.max_lanes(_intervals(spark, sf_dir), "l_orderkey")


def lane_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lane of each line of an order in a drawing of its intervals without overlaps."""
    return an.lanes(_intervals(spark, sf_dir), "l_orderkey", "l_linenumber")


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as intervals: start from the part, length from the quantity."""
    return views.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 100).alias("start"), (F.col("l_partkey") % 100 + F.col("l_quantity").cast("long") + 1).alias("end"))


def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that overlap no earlier line of their order: an anti-join on the overlap."""
    every = _intervals(spark, sf_dir)
    other = every.select("l_orderkey", F.col("l_linenumber").alias("n2"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    key = (every["l_orderkey"] == other["l_orderkey"]) & (F.col("n2") < F.col("l_linenumber")) & (F.col("start") < F.col("e2")) & (F.col("end") > F.col("s2"))
    return every.join(other, key, "left_anti").select("l_orderkey", "l_linenumber")


_REF, _QUERY = "concat(substr(seq, 1, 20), '--', substr(seq, 21))", "concat(substr(seq, 1, 9), translate(substr(seq, 10, 4), 'ACGT', 'GCTT'), substr(seq, 14, 7), 'GG', substr(seq, 21, 10), '---', substr(seq, 34))"


def aligned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sequences of 40 bases or more against themselves with edits; dealt, so that a task which looks at them in Python
    is not the one that folds them, and has one worker."""
    return views.dealt(views.text_dna(spark, sf_dir)).where("length(seq) >= 40").selectExpr("doc_id AS id", f"{_REF} AS ref_aligned", f"{_QUERY} AS query_aligned", "seq AS ref")


def variant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.variant_columns(aligned_pairs(spark, sf_dir))


def mutation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.mutation_blocks(aligned_pairs(spark, sf_dir))


def mutation_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = aligned_pairs(spark, sf_dir)
    return va.codon_impact(va.mutation_blocks(pairs), pairs.select("id", "ref")).select("id", "start", "kind", "impact", "protein", "severity")


def mutation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.mutation_counts(va.mutation_blocks(aligned_pairs(spark, sf_dir)))


def hydrophilicity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tg.hydrophilicity(views.text_protein(spark, sf_dir)).select("doc_id", "pos", F.round("mean", 6).alias("mean"))


def tm_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.text_protein(spark, sf_dir).select("doc_id", F.explode(tg.membrane_regions("seq")).alias("r")).select("doc_id", "r.start", "r.end", F.round("r.mean", 6).alias("mean"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tg.epitopes(views.text_protein(spark, sf_dir))


def epitope_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).select("doc_id", "start", F.round("score", 6).alias("score"))


def epitopes_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).where("kept").select("doc_id", "start", F.round("score", 6).alias("score"), "exposed")


def vaccine_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tg.vaccine_targets(_windows(spark, sf_dir)).select("doc_id", "start", F.round("score", 6).alias("score"), "rank")


def mass_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    compounds = metabolites(spark, sf_dir).select(F.col("p_partkey").alias("compound_id"), chem.formula_mass(F.col("formula")).alias("mass"))
    observed = views.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("25.0D + (s_suppkey * 37 % 5000) / 10.0D").alias("mz"))
    return ms.mass_search(observed, compounds, ppm=500.0).select("id", "compound_id", F.round("ppm", 3).alias("ppm"))


def metabolite_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compounds whose name, class or formula holds the text, upper or lower case."""
    m = metabolites(spark, sf_dir)
    hit = lambda c, t: F.contains(F.lower(c), F.lit(t))
    return m.where(hit(F.col("p_name"), "blue") | hit(F.col("p_type"), "steel") | hit(F.col("formula"), "nacl")).select("p_partkey", "p_name", "formula")


def library_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.read(spark, sf_dir, "documents")
    return d.where((F.col("lang") == "en") & F.contains(F.lower(F.concat_ws(" ", "source", "text")), F.lit("the"))).select("doc_id", "lang", "source")


def library_sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten longest of each source."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return views.read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", rank.alias("rank")).where("rank <= 10")


def lab_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TYPE-yyyymmdd-NNN, numbered within type and day: the events of the hours before are summed, those of the hour ranked."""
    e = views.read(spark, sf_dir, "events").select("event_id", "ts", F.upper(F.substring("event_type", 1, 3)).alias("kind"), F.date_format("ts", "yyyyMMdd").alias("day"), F.hour("ts").alias("hour"))
    hours = e.groupBy("kind", "day", "hour").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("kind", "day").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = e.withColumn("r", F.row_number().over(Window.partitionBy("kind", "day", "hour").orderBy("ts", "event_id")))
    number = (F.col("before") + F.col("r")).cast("string")
    numbered = ranked.join(hours.select("kind", "day", "hour", before.alias("before")), ["kind", "day", "hour"])
    return numbered.select("event_id", F.concat_ws("-", "kind", "day", F.when(F.length(number) >= 3, number).otherwise(F.lpad(number, 3, "0"))).alias("lab_code"))


def fasta_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The FASTA record of each document's sequence, named by its id and described by its language."""
    records = views.text_dna(spark, sf_dir).select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.coalesce("lang", F.lit("")).alias("description"), F.col("seq").alias("sequence"))
    return fasta_text(records).select(F.col("value").alias("record"))


def activity_by_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(8)


def activity_top_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


QUERIES = {
    f.__name__: f
    for f in (species_identify_topn, species_confidence, domain_classify, kmer_jaccard_pairs, kmer_classes, kmer_distances, p_distance_matrix, seed_best_diagonal, orf_scan, orf_best_frame, orf_best_protein, gff3_lines, coverage_depth, max_lanes, lane_assignment, interval_overlap, variant_columns, mutation_blocks, mutation_impact, mutation_counts, hydrophilicity_profile, tm_regions, epitope_windows, epitopes_nms, vaccine_targets, mass_search, metabolite_search, library_search, library_sort_topk, lab_codes, fasta_lines, activity_by_module, activity_top_users)
}


def _kmers_sql(k: int) -> str:
    return f", k AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(length(seq) - {k - 2}, 1)), lambda i: hash(substr(seq, i, {k})))) AS own FROM v), x AS (SELECT doc_id, len(own) AS size, unnest(own) AS kmer FROM k), s AS (SELECT a.doc_id AS query_id, b.doc_id AS ref_id, count(*) AS shared, 100.0::DOUBLE * count(*) / (any_value(a.size) + any_value(b.size) - count(*)) AS similarity FROM x a JOIN x b USING (kmer) WHERE a.doc_id % 50 = 0 GROUP BY ALL)"


_SIMILAR = f""", k AS (SELECT doc_id AS id, list_sort(list_distinct(list_transform(range(1, greatest(length(seq) - {K - 2}, 1)), lambda i: substr(seq, i, {K})))) AS own FROM v),
c AS (SELECT id, own, min(id) OVER (PARTITION BY md5(array_to_string(own, ' '))) AS class_id FROM k WHERE len(own) > 0), x AS (SELECT id, len(own) AS size, unnest(own) AS kmer FROM c WHERE id = class_id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared, 100.0::DOUBLE * count(*) / (any_value(a.size) + any_value(b.size) - count(*)) AS similarity FROM x a JOIN x b ON a.kmer = b.kmer AND a.id < b.id
  AND 100 * least(a.size, b.size) >= 80 * greatest(a.size, b.size) GROUP BY ALL HAVING similarity >= 80)"""
_RANKED = _kmers_sql(K) + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, ref_id)::INT AS rank FROM s)"
_SIX = ", f AS (SELECT doc_id, length(seq) AS n, st AS strand, fr AS frame, substr(CASE WHEN st = '+' THEN seq ELSE reverse(translate(seq, 'ACGT', 'TGCA')) END, fr + 1) AS dna FROM v, (VALUES ('+'), ('-')) a(st), (VALUES (0), (1), (2)) b(fr)), p AS (SELECT doc_id, n, strand, frame, " + codons_sql("dna") + " AS protein FROM f)"
_ORFS = _SIX + """, g AS (SELECT doc_id, n, strand, frame, generate_subscripts(string_split(protein, '*'), 1) AS i, unnest(string_split(protein, '*')) AS s, len(string_split(protein, '*')) AS k FROM p),
o AS (SELECT *, coalesce(sum(length(s) + 1) OVER (PARTITION BY doc_id, strand, frame ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos0 FROM g),
w AS (SELECT doc_id, n, strand, frame, (frame + 3 * (pos0 + instr(s, 'M') - 1))::INT AS start, (length(s) + 1 - instr(s, 'M'))::INT AS n_aa FROM o WHERE i < k AND instr(s, 'M') > 0),
q AS (SELECT doc_id, strand, frame::INT AS frame, start, (start + 3 * (n_aa + 1))::INT AS end, (3 * (n_aa + 1))::INT AS length, n_aa, CASE WHEN strand = '+' THEN start ELSE n - start - 3 * (n_aa + 1) END::INT AS forward_start FROM w WHERE 3 * (n_aa + 1) >= 100),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, strand, frame, start)::INT AS rank FROM q QUALIFY rank <= 200)"""
_LINES = "i AS (SELECT l_orderkey, l_linenumber, l_partkey % 100 AS s, l_partkey % 100 + l_quantity::BIGINT + 1 AS e FROM lineitem)"
_DEPTH = f"WITH {_LINES}, ev AS (SELECT l_orderkey, t AS start, sum(d) AS d FROM (SELECT l_orderkey, s AS t, 1 AS d FROM i UNION ALL SELECT l_orderkey, e, -1 FROM i) GROUP BY ALL), c AS (SELECT l_orderkey, start, lead(start) OVER w AS end, (sum(d) OVER w)::BIGINT AS depth FROM ev WINDOW w AS (PARTITION BY l_orderkey ORDER BY start)) "
_COLUMNS = f", al AS (SELECT doc_id AS id, seq, {_REF} AS r, {_QUERY} AS q FROM v WHERE length(seq) >= 40), c AS (SELECT id, seq, generate_subscripts(string_split(r, ''), 1) - 1 AS pos, unnest(string_split(r, '')) AS ref, unnest(string_split(q, '')) AS alt FROM al)"
_BLOCKS = _COLUMNS + """, t AS (SELECT *, CASE WHEN ref = alt THEN 'equal' WHEN ref = '-' THEN 'insertion' WHEN alt = '-' THEN 'deletion' ELSE 'substitution' END AS kind, coalesce(sum((ref <> '-')::INT) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos0 FROM c),
u AS (SELECT *, coalesce(lag(kind) OVER (PARTITION BY id ORDER BY pos) <> kind, true)::INT AS o FROM t), w AS (SELECT *, sum(o) OVER (PARTITION BY id ORDER BY pos) AS blk FROM u),
bl AS (SELECT id, any_value(seq) AS seq, min(pos0)::INT AS start, kind, replace(string_agg(ref, '' ORDER BY pos), '-', '') AS ref, replace(string_agg(alt, '' ORDER BY pos), '-', '') AS alt FROM w WHERE kind <> 'equal' GROUP BY id, blk, kind)"""


BLOSUM_FLAT = str([va.BLOSUM[a, b] for a in RESIDUES for b in RESIDUES])
_TENTHS = ", e AS (SELECT doc_id, generate_subscripts(string_split(seq, ''), 1) - 1 AS pos, unnest(string_split(seq, '')) AS aa, length(seq) AS n FROM v WHERE seq <> ''), h AS (SELECT *, CASE aa {} END AS x FROM e)"
_HP = _TENTHS.format(" ".join(f"WHEN '{r}' THEN {round(10 * v)}" for r, v in HYDROPHILICITY.items()))
_KD = " ".join(f"WHEN '{r}' THEN {round(10 * v)}" for r, v in HYDROPATHY.items())
_MEMBRANE = (
    _HP
    + f""", kd AS (SELECT doc_id, pos, n, CASE aa {_KD} END AS x FROM e), hit AS (SELECT *, pos + 19 <= n AND sum(x) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 18 FOLLOWING) >= 304 AS hit FROM kd),
ins AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) AS inside FROM hit), r AS (SELECT *, sum((NOT inside)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM ins)"""
)
#: Greedy choice of windows, best first: in each round the windows go in that no better window left overlaps.
_NMS = (
    _MEMBRANE
    + """, w AS MATERIALIZED (SELECT doc_id, pos AS start, n, sum(x) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS sums FROM h),
inw AS (SELECT doc_id, pos AS start, bool_or(inside) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS inside FROM ins),
s AS MATERIALIZED (SELECT doc_id, start, sums, least(100, greatest(0, (sums / 90.0::DOUBLE + 10) / 20 * 100)) AS score, NOT inside AND sums > 0 AS exposed FROM w JOIN inw USING (doc_id, start) WHERE start + 9 <= n AND (sums / 90.0::DOUBLE + 10) / 20 * 100 >= 55),
g AS (SELECT doc_id, list({'start': start, 'sums': sums} ORDER BY sums DESC, start) AS rest, []::BIGINT[] AS chosen FROM s GROUP BY doc_id UNION ALL
  SELECT doc_id, list_filter(rest, lambda y: abs(y.start - rest[1].start) >= 9), list_append(chosen, rest[1].start) FROM g WHERE len(rest) > 0),
kept AS (SELECT s.* FROM s JOIN (SELECT doc_id, unnest(chosen) AS start FROM g WHERE len(rest) = 0) USING (doc_id, start))"""
)
SQL = {
    "species_identify_topn": sql("text_dna", _RANKED + " SELECT query_id, ref_id, shared, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 10"),
    "species_confidence": sql("text_dna", _RANKED + " SELECT CASE WHEN similarity >= 70 THEN 'High' WHEN similarity >= 40 THEN 'Moderate' WHEN similarity >= 15 THEN 'Low' ELSE 'Very low' END AS confidence, count(*) AS n FROM r WHERE rank <= 10 GROUP BY ALL"),
    "domain_classify": sql("text_dna", _RANKED + " SELECT query_id, ref_id, source AS domain FROM (SELECT * FROM r WHERE rank <= 2 AND query_id <> ref_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) = 1) JOIN documents ON doc_id = ref_id"),
    "kmer_jaccard_pairs": sql("text_dna", _SIMILAR + " SELECT a, b, shared, round(similarity, 6) AS similarity FROM p"),
    "kmer_classes": sql("text_dna", _SIMILAR + ", l AS (SELECT class_id, count(*) AS links FROM (SELECT a AS class_id FROM p UNION ALL SELECT b FROM p) GROUP BY ALL) SELECT id, class_id, coalesce(links, 0) AS links FROM c LEFT JOIN l USING (class_id)"),
    "kmer_distances": sql("text_dna", _kmers_sql(K) + " SELECT query_id, ref_id, round(1 - similarity / 100, 6) AS distance FROM s WHERE query_id <> ref_id"),
    "p_distance_matrix": sql("text_dna", "SELECT a.doc_id AS i, b.doc_id AS j, round(hamming(a.seq, b.seq)::DOUBLE / length(a.seq), 6) AS distance FROM v a JOIN v b ON length(a.seq) = length(b.seq) WHERE a.seq <> '' AND a.doc_id % 50 = 0 AND a.doc_id <> b.doc_id"),
    "seed_best_diagonal": sql(
        "text_dna",
        f""", p AS (SELECT doc_id AS id, seq AS a, concat('ACGTT', substr(seq, 9)) AS b FROM v), x AS (SELECT id, i, substr(a, i + 1, {K}) AS k FROM (SELECT id, a, unnest(range(0, length(a) - {K - 1})) AS i FROM p)),
        y AS (SELECT id, j, substr(b, j + 1, {K}) AS k FROM (SELECT id, b, unnest(range(0, length(b) - {K - 1})) AS j FROM p)),
        d AS (SELECT id, i - j AS diagonal, count(*) AS seeds, min(i * 1000000 + j) AS f FROM x JOIN y USING (id, k) GROUP BY ALL)
        SELECT id, diagonal::INT AS diagonal, seeds FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY seeds DESC, f) = 1""",
    ),
    "orf_scan": sql("text_dna", _ORFS + " SELECT * FROM z"),
    "orf_best_frame": sql("text_dna", _SIX + ", l AS (SELECT doc_id, strand, frame::INT AS frame, list_max(list_transform(string_split(protein, '*'), lambda x: CASE WHEN instr(x, 'M') > 0 THEN length(x) - instr(x, 'M') + 1 ELSE 0 END))::INT AS longest FROM p) SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY longest DESC, strand, frame) = 1"),
    "orf_best_protein": sql("text_dna", _SIX + """, m AS (SELECT doc_id, strand, frame::INT AS frame, protein AS whole, list_transform(string_split(protein, '*'), lambda x: CASE WHEN instr(x, 'M') > 0 THEN substr(x, instr(x, 'M')) ELSE '' END) AS own FROM p),
        l AS (SELECT *, own[list_position(list_transform(own, lambda x: length(x)), list_max(list_transform(own, lambda x: length(x))))] AS best FROM m)
        SELECT doc_id, strand, frame, CASE WHEN best = '' THEN whole ELSE best END AS protein FROM l QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(best) DESC, strand, frame) = 1"""),
    "gff3_lines": sql("text_dna", _ORFS + " SELECT doc_id, concat_ws(chr(9), 'doc' || doc_id, 'helixframe', 'ORF', forward_start + 1, forward_start + length, '.', strand, '0', 'Note=ORF%20of%20' || n_aa || '%20aa') AS line FROM z"),
    "coverage_depth": _DEPTH + "SELECT * FROM c WHERE depth > 0",
    "max_lanes": _DEPTH + "SELECT l_orderkey, max(depth) AS lanes FROM c WHERE depth > 0 GROUP BY ALL",
    "interval_overlap": f"WITH {_LINES} SELECT l_orderkey, l_linenumber FROM i a WHERE NOT EXISTS (SELECT 1 FROM i b WHERE a.l_orderkey = b.l_orderkey AND b.l_linenumber < a.l_linenumber AND a.s < b.e AND a.e > b.s)",
    "variant_columns": sql("text_dna", _COLUMNS + " SELECT id, pos::INT AS pos, ref, alt, CASE WHEN ref = '-' OR alt = '-' THEN 'Indel' ELSE 'SNP' END AS kind FROM c WHERE ref <> alt"),
    "mutation_blocks": sql("text_dna", _BLOCKS + " SELECT id, start, (start + length(ref))::INT AS end, ref, alt, kind, CASE kind WHEN 'substitution' THEN concat(start + 1, ref, '>', alt) WHEN 'insertion' THEN concat(start, '_', start + 1, 'ins', alt) ELSE concat(start + 1, CASE WHEN length(ref) = 1 THEN '' ELSE concat('_', start + length(ref)) END, 'del', ref) END AS notation FROM bl"),
    "mutation_impact": sql("text_dna", _BLOCKS + f""", m AS (SELECT *, start // 3 AS c0, greatest((start + length(ref) - 1) // 3, start // 3) AS c1 FROM bl), m1 AS (SELECT *, substr(seq, 3 * c0 + 1, 3 * (c1 - c0 + 1)) AS codons FROM m),
        m2 AS (SELECT *, concat(substr(codons, 1, start - 3 * c0), alt, substr(codons, start - 3 * c0 + length(ref) + 1)) AS changed FROM m1), m3 AS (SELECT *, {codons_sql('codons')} AS aa, {codons_sql('changed')} AS bb, kind = 'substitution' AS sub FROM m2),
        m4 AS (SELECT *, CASE WHEN sub AND length(codons) < 3 * (c1 - c0 + 1) THEN 'unknown' WHEN sub AND aa = bb THEN 'synonymous' WHEN sub AND length(replace(bb, '*', '')) < length(bb) AND length(replace(aa, '*', '')) = length(aa) THEN 'nonsense' WHEN sub THEN 'missense'
          WHEN greatest(length(ref), length(alt)) % 3 = 0 THEN 'inframe' ELSE 'frameshift' END AS impact FROM m3)
        SELECT id, start, kind, impact, CASE WHEN impact IN ('missense', 'nonsense', 'synonymous') THEN concat('p.', aa, c0 + 1, bb) END AS protein,
        CASE WHEN impact = 'missense' AND length(aa) = 1 THEN coalesce({BLOSUM_FLAT}[20 * (nullif(instr('{RESIDUES}', aa), 0) - 1) + nullif(instr('{RESIDUES}', bb), 0)], 0) ELSE 0 END::INT AS severity FROM m4"""),
    "mutation_counts": sql("text_dna", _BLOCKS + ", y AS (SELECT *, (ref IN ('A', 'G') AND alt IN ('A', 'G')) OR (ref IN ('C', 'T') AND alt IN ('C', 'T')) AS ts FROM bl) SELECT id, count_if(kind = 'substitution')::BIGINT AS substitutions, count_if(kind = 'insertion')::BIGINT AS insertions, count_if(kind = 'deletion')::BIGINT AS deletions, count_if(kind = 'substitution' AND ts)::BIGINT AS transitions, count_if(kind = 'substitution' AND NOT ts)::BIGINT AS transversions FROM y GROUP BY id"),
    "hydrophilicity_profile": sql("text_protein", _HP + " SELECT doc_id, pos::INT AS pos, round(sum(x) OVER w / (10.0::DOUBLE * count(*) OVER w), 6) AS mean FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"),
    "epitope_windows": sql("text_protein", _HP + ", w AS (SELECT doc_id, pos, n, least(100, greatest(0, (sum(x) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) / 90.0::DOUBLE + 10) / 20 * 100)) AS score FROM h) SELECT doc_id, pos::INT AS start, round(score, 6) AS score FROM w WHERE pos + 9 <= n AND score >= 55"),
    "tm_regions": sql("text_protein", _MEMBRANE + " SELECT doc_id, min(pos)::INT AS start, (max(pos) + 1)::INT AS end, round(sum(x) / (10.0::DOUBLE * count(*)), 6) AS mean FROM r WHERE inside GROUP BY doc_id, run"),
    "epitopes_nms": sql("text_protein", _NMS + " SELECT doc_id, start::INT AS start, round(score, 6) AS score, exposed FROM kept"),
    "vaccine_targets": sql("text_protein", _NMS + " SELECT doc_id, start::INT AS start, round(score, 6) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY sums DESC, start)::INT AS rank FROM kept WHERE exposed QUALIFY rank <= 8"),
    "mass_search": f"WITH m AS ({FORMULA_SQL}), a AS (SELECT p_partkey, unnest({ATOMS_SQL}) AS a FROM m), c AS (SELECT p_partkey AS compound_id, sum(a[2]::INT * {_mass_case(MONOISOTOPIC)}) + 1.007276::DOUBLE AS t FROM a GROUP BY p_partkey), o AS (SELECT s_suppkey AS id, 25.0::DOUBLE + (s_suppkey * 37 % 5000) / 10.0::DOUBLE AS mz FROM supplier) SELECT id, compound_id, round((mz - t) / t * 1e6::DOUBLE, 3) AS ppm FROM o JOIN c ON abs((mz - t) / t * 1e6::DOUBLE) <= 500",
    "metabolite_search": f"SELECT p_partkey, p_name, formula FROM ({FORMULA_SQL}) WHERE contains(lower(p_name), 'blue') OR contains(lower(p_type), 'steel') OR contains(lower(formula), 'nacl')",
    "library_search": "SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND contains(lower(concat_ws(' ', source, text)), 'the')",
    "library_sort_topk": "SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents QUALIFY rank <= 10",
    "lab_codes": "SELECT event_id, concat_ws('-', k, d, CASE WHEN r >= 100 THEN r::VARCHAR ELSE lpad(r::VARCHAR, 3, '0') END) AS lab_code FROM (SELECT event_id, upper(substr(event_type, 1, 3)) AS k, strftime(ts, '%Y%m%d') AS d, row_number() OVER (PARTITION BY upper(substr(event_type, 1, 3)), strftime(ts, '%Y%m%d') ORDER BY ts, event_id) AS r FROM events)",
    "fasta_lines": sql("text_dna", "SELECT concat('>doc', doc_id, CASE WHEN coalesce(lang, '') <> '' THEN ' ' || lang ELSE '' END, chr(10), seq) AS record FROM v"),
    "activity_by_module": "SELECT event_type, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, event_type LIMIT 8",
    "activity_top_users": "SELECT user_id, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, user_id LIMIT 10",
}
