import struct

from helixframe.functions import sequence as sq
from helixframe.operators import quality as q
from helixframe.sources.sequences import fasta_text, fastq_text, parse_trace, read_fasta, read_fastq, read_sequences
from helixframe.streaming.activity import activity_windows
from pyspark.sql import functions as F


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "a.fa").write_text("preamble\r\n>one first read\r\nACGT\r\nac gt\n>empty\n>two\nMKLV*\n")
    rows = [tuple(r) for r in read_fasta(spark, str(tmp_path / "a.fa")).where("name <> 'preamble'").collect()]
    assert ("one", "first read", "ACGTACGT", "dna") in rows and ("two", "", "MKLV*", "protein") in rows and len(rows) == 2
    fasta_text(read_fasta(spark, str(tmp_path / "a.fa")).where("name = 'one'")).write.text(str(tmp_path / "out"))
    assert read_fasta(spark, str(tmp_path / "out")).select("sequence").collect()[0][0] == "ACGTACGT"


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r1 x\nACGT\n+\nIIII\n\nbad\nAC\n+\nII\n@\nAC\n+\nI\n")
    df = read_fastq(spark, str(tmp_path / "a.fq"))
    assert [(r["name"], r["sequence"], r["quality_scores"]) for r in df.orderBy("idx").collect()] == [("r1", "ACGT", [40] * 4), ("read_2", "AC", None)]
    assert fastq_text(df.where("name = 'r1'")).first()[0] == "@r1\nACGT\n+\nIIII"


def test_trace():
    entry = lambda tag, number, payload, at: struct.pack(">4sihhii", tag, number, 2, 1, len(payload), len(payload)) + (payload.ljust(4, b"\0") if len(payload) <= 4 else struct.pack(">i", at)) + b"\0" * 4
    data = b"ABIF" + struct.pack(">h", 101) + struct.pack(">4sihhii", b"tdir", 1, 1023, 28, 3, 84) + struct.pack(">i", 40) + b"\0" * 10
    body = entry(b"PBAS", 1, b"TT", 0) + entry(b"PBAS", 2, b"ACGTA", 124) + entry(b"PCON", 2, bytes([9, 8, 7, 6]), 0)
    assert parse_trace(data[:40] + body + b"ACGTA") == ("ACGTA", [9, 8, 7, 6])
    assert parse_trace(b"nothing") == (None, None)


def test_trim_and_demultiplex_cases(spark):
    sheet = spark.createDataFrame([(1, "SampleA", "ACGT"), (2, "SampleB", "TTGG")], "idx int, sample string, barcode string")
    reads = spark.createDataFrame([(1, "ACGTAAAAACCCCC"), (2, "ACGAAAAAACCCCC"), (3, "GGGGGTTTTTCCCCC"), (4, "AC")], "id int, seq string")
    run = lambda k: {r["id"]: (r["sample"], r["seq"]) for r in q.demultiplex(reads, sheet, k).collect()}
    assert run(0) == {1: ("SampleA", "AAAAACCCCC"), 2: ("", "ACGAAAAAACCCCC"), 3: ("", "GGGGGTTTTTCCCCC"), 4: ("", "AC")}
    assert run(1)[2] == ("SampleA", "AAAAACCCCC")
    rows = spark.createDataFrame([(1, "AAACCCGGGAAGATCGGAAGAGC", [40] * 23), (2, "A" * 20, [35] * 10 + [5] * 10), (3, "ACGTAC", None)], "id int, seq string, qual array<int>")
    out = {r["id"]: r for r in q.trim(rows, min_length=8).collect()}
    assert (out[1]["seq"], out[1]["reason"]) == ("AAACCCGGGA", "adapter")
    assert (len(out[2]["seq"]), out[2]["reason"]) == (9, "low_quality")
    assert (out[3]["discarded"], out[3]["reason"]) == (True, "too_short")


def test_sequence_functions(spark):
    df = spark.createDataFrame([("ACGTN",), ("",), ("ATGTAAXX",)], "s string")
    one = lambda c: [r[0] for r in df.select(c).collect()]
    s = F.col("s")
    assert one(sq.reverse_complement(sq.reverse_complement(s))) == ["ACGTN", "", "ATGTAAXX"]
    assert one(sq.translate_codons(s)) == ["T", "", "M*"]
    assert one(sq.kmers(s, 4)) == [["ACGT", "CGTN"], [], ["ATGT", "TGTA", "GTAA", "TAAX", "AAXX"]]
    assert one(sq.detect_type(s)) == ["dna", "unknown", "protein"]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) as ts, if(id % 3 = 0, 'a', 'b') as event_type from range(200)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = activity_windows(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("hourly").collect())) == sorted(map(tuple, activity_windows(rows).collect()))


def test_files_that_only_begin_as_fastq_are_read_as_fasta(spark, tmp_path):
    (tmp_path / "a.txt").write_text("@no record\n>s1 x\nACGT\n")
    (tmp_path / "b.fq").write_text("@r1\nGG\n+\nII\n")
    (tmp_path / "c.fa").write_text(">s3\nAC\n")
    (tmp_path / "d.fq").write_text("@r2\nGG\n+\n")
    got = read_sequences(spark, str(tmp_path)).collect()
    assert sorted((r["name"], r["sequence"], r["quality_scores"]) for r in got) == [("r1", "GG", [40, 40]), ("s1", "ACGT", None), ("s3", "AC", None)]
