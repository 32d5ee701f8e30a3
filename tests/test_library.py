from pyspark.sql import functions as F
import pytest

from helixframe.functions.protein import residue_structure
from helixframe.functions.register import register
from helixframe.operators import library as lib
from helixframe.operators.annotation import best_frame, best_proteins, find_orfs
from helixframe.operators.scoring import MATRICES
from helixframe.operators.similarity import similar_documents, similar_sets
from helixframe.operators.variants import codon_impact, mutation_blocks
from helixframe.sources.sequences import barcode_sheet, platform, read_fasta, read_fastq, read_sequences, report_text, sanger_reads


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_projects_upserts_and_log(spark):
    s = spark.createDataFrame([(1, "a", "p1"), (2, "b", None), (3, "c", "p2"), (None, "d", "p1")], "id long, name string, project_id string")
    assert sorted(r["name"] for r in lib.in_project(s, "p1").collect()) == ["a", "d"] and rows(lib.in_project(s, None).select("id")) == [(2,)]
    assert lib.delete_project(s, "p1").count() == 2
    with pytest.raises(ValueError):
        lib.delete_project(s, "default")
    ids = spark.createDataFrame([(1,), (1,), (9,)], "id long")
    assert sorted(r["project_id"] or "" for r in lib.move(s, ids, "x").collect()) == ["", "p1", "p2", "x"]
    new = spark.createDataFrame([(2, "B", "p3"), (7, "e", "p3")], "id long, name string, project_id string")
    assert sorted(r["name"] for r in lib.upsert(s, new, "id").collect()) == ["B", "a", "c", "d", "e"]
    log = spark.createDataFrame([(i, i % 7) for i in range(150)], "id long, ts long")
    assert lib.last_entries(log, "id").count() == 100
    assert lib.owned(log.withColumn("owner_id", F.col("ts")), None).count() == 0 and lib.owned(log, None, admin=True).count() == 150


def test_sql_functions(spark):
    assert {"gc_content", "kmers", "orfs"} <= set(register(spark))
    assert rows(spark.sql("SELECT gc_content('GGAT'), reverse_complement('AACG'), poly_a_tail('CAAA'), melting_temperature('ACGT')")) == [(50.0, "CGTT", 3, 12.0)]
    assert rows(spark.sql("SELECT * FROM kmers('ACGTA', 4)")) == [(0, "ACGT"), (1, "CGTA")]
    assert rows(spark.sql("SELECT * FROM orfs('CATGAAATAGC', 9)")) == [("+", 1, 1, 10, 9)]


def test_reading_frames_of_odd_sequences(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "AT"), (4, "ATGTAA"), (5, "NNATGNNNTAGCC"), (6, "augaaauga"), (7, "AUGAAAUGA"), (7, "TCATTTCAT")], "doc_id long, seq string")
    got = sorted(rows(find_orfs(df, 6).select("doc_id", "strand", "start", "end", "n_aa", "forward_start", "rank")))
    assert got == [(4, "+", 0, 6, 1, 0, 1), (5, "+", 2, 11, 2, 2, 1), (7, "+", 0, 9, 2, 0, 1), (7, "-", 0, 9, 2, 0, 1)]


def test_similar_sets_against_brute_force(spark):
    import random

    rng, k = random.Random(3), 5
    base = ["".join(rng.choice("ACGT") for _ in range(rng.choice([12, 60, 200]))) for _ in range(12)]
    texts = [b if rng.random() < 0.2 else "".join(c if rng.random() > 0.01 else "A" for c in b) for b in base * 6] + [None, "", "ACG", "ACGTACGTACGT", "CGTACGTACGTA"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, seq string")
    sets = {i: frozenset(t[j : j + k] for j in range(len(t) - k + 1)) for i, t in enumerate(texts) if t}
    sets = {i: s for i, s in sets.items() if s}
    first = {}
    for i, s in sets.items():
        first.setdefault(s, i)
    names = sorted(first.values())
    want = {(a, b): len(sets[a] & sets[b]) for a in names for b in names if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    pairs, classes = similar_sets(df, k, 80)
    assert {(r["a"], r["b"]): r["shared"] for r in pairs.collect()} == want and len(want) > 20
    assert {r["id"]: r["class_id"] for r in classes.collect()} == {i: first[s] for i, s in sets.items()}
    links = {r["id"]: r["links"] for r in similar_documents(df, k, 80).collect()}
    assert links == {i: sum(first[s] in p for p in want) for i, s in sets.items()}


def test_codons_of_every_substitution(spark):
    pairs = [(1, "GGTAAA", "GGCAAA"), (2, "TTTAAA", "TATAAA"), (3, "TGGAAA", "TGAAAA"), (4, "AAATTTCCC", "AAGGTTCCC"), (5, "AAATTTCCC", "AATATTCCC"), (6, "ACGTTTACGA", "ACG---ACGA"), (7, "ACGTAC", "AC-TAC"), (8, "AAATT", "AAATA"), (9, "GGTGGTAAA", "GGCGGCAAA")]
    df = spark.createDataFrame(pairs, "id long, ref_aligned string, query_aligned string")
    got = {}
    for r in codon_impact(mutation_blocks(df), df.selectExpr("id", "ref_aligned AS ref")).collect():
        got.setdefault(r["id"], []).append((r["impact"], r["protein"], r["severity"]))
    assert got[1] == [("synonymous", "p.G1G", 0)] and got[2] == [("missense", "p.F1Y", MATRICES["blosum62"]["F", "Y"])] and got[3] == [("nonsense", "p.W1*", 0)]
    assert got[4] == [("missense", "p.KF1KV", 0)] and got[5] == [("missense", "p.KF1NI", 0)] and got[6] == [("inframe", None, 0)] and got[7] == [("frameshift", None, 0)]
    assert got[8] == [("unknown", None, 0)] and sorted(got[9]) == [("synonymous", "p.G1G", 0), ("synonymous", "p.G2G", 0)]


def test_residue_structure(spark):
    df = spark.createDataFrame([("",), ("M",), ("EEEEEVVVVVGGGGG",), ("EVG",)], "s string")
    assert [[k[0] for k in r[0]] for r in df.select(residue_structure(F.col("s"))).collect()] == [[], ["H"], list("HHHHHSSSSSCCCCC"), list("HHH")]


def test_files_of_all_kinds(spark, tmp_path):
    (tmp_path / "a.fa").write_text("notes\nby hand ACGT\n>one first\nAC\nGT\n>two\nMKLV*\n")
    (tmp_path / "b.fa").write_text(">three\nGG>G\n")
    (tmp_path / "c.fq").write_text("".join(f"@r{i} x\nACGT\n+\nIIII\n" for i in range(3000)))
    assert sorted(rows(read_fasta(spark, str(tmp_path / "*.fa")).select("name", "sequence"))) == [("one", "ACGT"), ("three", "GG>G"), ("two", "MKLV*")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = read_fastq(spark, str(tmp_path / "c.fq"))
        assert got.count() == 3000 and got.where("name <> concat('r', idx) OR sequence <> 'ACGT'").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert read_sequences(spark, str(tmp_path)).groupBy("seq_type").count().count() == 2
    (tmp_path / "sheet.csv").write_text("SampleA,acgt\n\nbad\nSampleB, ttgg\n,AAAA\n")
    assert sorted(rows(barcode_sheet(spark, str(tmp_path / "sheet.csv")).select("sample", "barcode"))) == [("SampleA", "ACGT"), ("SampleB", "TTGG")]


def test_platforms(spark):
    cases = [("x.ab1", None, "sanger"), ("x", "ABIF\0", "sanger"), ("x.fq", "@M1:2:FC:1:2:3:4 1:N:0:AC\nACGT", "illumina"), ("x", "@a runid=1 ch=3\nAC", "nanopore"), ("x", ">m1/12/0_99\nAC", "pacbio"), ("x", "@m1/12/ccs\nAC", "pacbio"), ("x", " \n@r1\nAC", "illumina"), ("x", ">r1\nAC", "unknown"), (None, None, "unknown"), ("x", "", "unknown")]
    df = spark.createDataFrame(cases, "f string, p string, want string")
    assert df.where(platform(F.col("f"), F.col("p")) != F.col("want")).count() == 0


def test_sanger_and_report(spark):
    traces = spark.createDataFrame([("a", "NNACGTNN", [2, 2, 30, 30, 30, 30, 2, 2]), ("b", "ac gt", [30] * 5), ("c", None, None), ("d", "ACGT", None)], "path string, bases string, quality_scores array<int>")
    assert sorted(rows(sanger_reads(traces))) == [("a", "ACGT", [30] * 4), ("b", "ACGT", None), ("d", "ACGT", None)]
    lines = [r["value"] for r in report_text(spark.createDataFrame([(2, "xy"), (1, None)], "id int, name string"), "Report", "id").orderBy("line").collect()]
    assert lines == ["=" * 70, "REPORT", "=" * 70, "id  name  ", "-" * 10, "1         ", "2   xy    "]


def test_platforms_by_documented_headers(spark):
    rows = [
        ("r.fastq", "@EAS139:136:FC706VJ:2:2104:15343:197393 1:Y:18:ATCACG\nACGT", "illumina"), ("r.fastq", "@read1 runid=ab sampleid=s read=12 ch=5 start_time=x\nA", "nanopore"),
        ("r.fasta", ">m140415_143853_42175_c100635972550000001823121909121417_s1_p0/553/3100_11230\nA", "pacbio"), ("r.bam", "@m64011/4194375/ccs\nA", "pacbio"),
        ("x.ab1", "anything", "sanger"), ("x.SCF", None, "sanger"), ("x.txt", "ABIF..", "sanger"), ("x.fq", "\n  @SRR1 length=5\nACGTA", "illumina"), ("x.fa", ">a/b/c\nA", "unknown"),
        ("x.fa", ">a:1:b:2:3:4:5 1:N:0:X", "unknown"), ("ab1", ">s", "unknown"), ("x.txt", "", "unknown"), (None, None, "unknown"),
    ]
    found = spark.createDataFrame(rows, "f string, p string, want string").select("f", "p", "want", platform(F.col("f"), F.col("p")).alias("got")).collect()
    assert [(r["f"], r["p"], r["got"]) for r in found] == [(r["f"], r["p"], r["want"]) for r in found]


def test_best_frames_and_proteins(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "AC"), (4, "CCCTAACCC"), (5, "ATGAAATAGATGCCC"), (6, "TTTCATTTTTTTTTTTTTTTTTTTTT"), (None, "CATGAAACCC")], "doc_id long, seq string")
    want = {1: ("+", 0, ""), 2: ("+", 0, ""), 3: ("+", 0, ""), 4: ("+", 0, "P*P"), 5: ("+", 0, "MK"), 6: ("-", 2, "MK"), None: ("+", 1, "MKP")}
    assert {r[0]: tuple(r)[1:] for r in best_proteins(df).collect()} == want
    assert {r[0]: tuple(r)[1:] for r in best_frame(df).collect()} == {k: (s, f, 0 if k in (1, 2, 3, 4) else len(p)) for k, (s, f, p) in want.items()}
