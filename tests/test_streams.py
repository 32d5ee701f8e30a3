import os
from datetime import datetime, timedelta
from pathlib import Path

from helixframe.operators import quality as q
from helixframe.sources.sequences import read_fastq
from helixframe.streaming.reads import fastq_records, run_available, sample_counts, sessions
from pyspark.sql import functions as F

START = datetime(2024, 1, 1)


def stream_of(spark, folder, batches, schema):
    """A stream that reads each of the ``batches`` of rows in a batch of its own."""
    folder.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}-{k}")
        path = next(Path(f"{folder}-{k}").glob("part-*")).rename(folder / f"b{k}.parquet")
        os.utime(path, (1_000_000 + k, 1_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_records_split_over_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = "".join(f"@r{i} x\nACGT{'ACGT'[i % 4] * (i % 5)}\n+\n{'I' * (4 + i % 5 - (i == 7))}\n" for i in range(25)) + "no mark\nA\n+\nI\n@last\nAC\n"
    (tmp_path / "in" / "a.fq").write_text(text)
    (tmp_path / "in" / "b.fq").write_text("@b\nGG\n+\nII\n")
    want = sorted(tuple(r) for r in read_fastq(spark, str(tmp_path / "in")).drop("file").collect())
    lines = [("a", n, START + timedelta(seconds=n), v) for n, v in enumerate(text.splitlines())] + [("b", n, START, v) for n, v in enumerate("@b GG + II".split())]
    batches = [lines[k::7] for k in (3, 0, 6, 1, 5, 2, 4)]
    batches[2] += [("a", None, START, "x"), (None, 0, START, "@x"), ("a", 1, None, "x")]
    stream = stream_of(spark, tmp_path / "lines", batches, "file string, n long, ts timestamp, value string")
    got = run_available(fastq_records(stream), "records")
    assert sorted(tuple(r) for r in got.drop("file").collect()) == want and len(want) == 26


def test_late_lines_and_incomplete_records_go(spark, tmp_path):
    hour = timedelta(hours=1)
    record = lambda idx, ts, *which: [("a", 4 * idx + k, ts, ("@r", "AC", "+", "II")[k]) for k in which]
    batches = [record(0, START, 0, 1) + record(1, START, 0, 1, 2), record(1, START + timedelta(minutes=5), 3), record(2, START + 3 * hour, 0, 1, 2, 3), record(9, START + 4 * hour, 0), record(0, START, 2, 3), record(0, START + 5 * hour, 2, 3)]
    stream = stream_of(spark, tmp_path / "lines", batches, "file string, n long, ts timestamp, value string")
    assert sorted(r["idx"] for r in run_available(fastq_records(stream), "late").collect()) == [1, 2]


def test_running_counts_are_the_batch_ones(spark, tmp_path):
    sheet = spark.createDataFrame([(1, "one", "ACGT"), (2, "two", "TTGG")], "idx int, sample string, barcode string")
    rows = [(START, s, [30] * len(s) if s else None) for s in ("ACGT" + "A" * 30, "TTGG" + "C" * 40, "TTGC" + "C" * 5, "G" * 50, "", None, "ACGT" + "A" * 30)]
    schema = "ts timestamp, seq string, qual array<int>"
    counted = lambda df: sample_counts(q.trim(q.demultiplex(df, sheet)))
    want = sorted(tuple(r) for r in counted(spark.createDataFrame(rows, schema)).collect())
    got = run_available(counted(stream_of(spark, tmp_path / "reads", [rows[:2], rows[2:5], rows[5:]], schema)), "counts", "complete")
    assert sorted(tuple(r) for r in got.collect()) == want and ("one", 2, 2, 60, 0) in want


def test_sessions(spark, tmp_path):
    minutes = {"a": [0, 10, 40, 71, 72], "b": [5, 500], None: [3]}
    rows = [(u, START + timedelta(minutes=m)) for u, ms in minutes.items() for m in ms] + [("a", None)]
    at = lambda df: sorted((r["user"] or "", (r["start"] - START) // timedelta(minutes=1), (r["end"] - START) // timedelta(minutes=1), r["n"]) for r in df.collect())
    want = [("", 3, 33, 1), ("a", 0, 70, 3), ("a", 71, 102, 2), ("b", 5, 35, 1), ("b", 500, 530, 1)]
    schema = "user string, ts timestamp"
    assert at(sessions(spark.createDataFrame(rows, schema), "user")) == want
    late = [("a", START), ("end", START + timedelta(days=2))]
    stream = stream_of(spark, tmp_path / "events", [rows[:3], rows[3:], [("end", START + timedelta(days=1))], late], schema)
    assert at(run_available(sessions(stream, "user"), "sessions").where("user <> 'end' OR user IS NULL")) == want
