"""Reads as streams: records put together from lines over batches, running counts by sample, sessions of events.

Quality reports, trimming and demultiplexing are row-local and run on streams as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from helixframe.operators.storage import shared_path
from helixframe.sources.sequences import fastq_fields

_PARTS = ", ".join(f"line{k} string" for k in range(4))


def _assemble(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The record of ``key`` once its four lines are there; until then they are the state."""
    if state.hasTimedOut:
        state.remove()
        return
    *lines, seen = state.get if state.exists else (None,) * 5
    for frame in frames:
        for n, value, ts in zip(frame["n"], frame["value"], frame["ts"], strict=True):
            lines[n % 4] = value
            seen = max(seen or 0, ts.value // 1_000_000)
    if None in lines:
        state.update((*lines, seen))
        state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs() + 1))
    else:
        if state.exists:
            state.remove()
        yield pd.DataFrame([(*key, *lines)], columns=["file", "idx", *(f"line{k}" for k in range(4))])


def fastq_records(lines: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The rows of ``read_fastq`` from a stream of (file, n, ts, value): the nth line of a file, from 0, blank ones left out.

    Lines may come in any order and in different batches; a group is one record, so no file is a hot key. A record whose
    missing lines do not come until the watermark, ``late`` behind the newest ``ts``, has passed its own lines is dropped,
    and so are lines older than the watermark. Lines with a null field are dropped. A line that comes again before its
    record is whole replaces the first; a whole record sent again comes out again.
    """
    own = lines.select("file", F.col("n").cast("long").alias("n"), "ts", "value").dropna()
    keyed = own.withColumn("idx", F.floor(F.col("n") / 4).cast("int")).withWatermark("ts", late).groupBy("file", "idx")
    rows = keyed.applyInPandasWithState(_assemble, f"file string, idx int, {_PARTS}", f"{_PARTS}, seen long", "append", GroupStateTimeout.EventTimeTimeout)
    return fastq_fields(rows)


def sample_counts(reads: DataFrame) -> DataFrame:
    """(sample, reads, kept, bases, bases_trimmed) of demultiplexed and trimmed reads: running sums on a stream."""
    kept = ~F.col("discarded")
    return reads.groupBy("sample").agg(
        F.count("*").alias("reads"), F.count_if(kept).alias("kept"), F.coalesce(F.sum(F.when(kept, F.length("seq")).cast("long")), F.lit(0)).alias("bases"), F.coalesce(F.sum(F.col("bases_trimmed").cast("long")), F.lit(0)).alias("bases_trimmed")
    )


def sessions(events: DataFrame, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(by, start, end, n): events of ``by`` no more than ``gap`` apart are one session, which ends ``gap`` after the last.

    Events without ``ts`` are dropped. On a stream, those behind the watermark go too; a table has none.
    """
    counted = events.withWatermark("ts", late).groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, with its state below the shared folder, and read what it wrote.

    Appended rows are written by the exactly-once file sink; in ``complete`` mode each batch replaces the table.
    """
    spark = stream.sparkSession
    out, state = shared_path(spark, name), shared_path(spark, name + "-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(out)
    else:
        spark.createDataFrame([], stream.schema).write.parquet(out)  # a stream without files has no batch
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
