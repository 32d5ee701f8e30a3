"""Queries that are the same on a stream and on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.operators import quality as q
from helixframe.plans import views
from helixframe.plans.reads import _DEMUX, _trim_sql, barcodes
from helixframe.plans.views import sql
from helixframe.streaming.activity import activity_windows
from helixframe.streaming.reads import run_available, sample_counts, sessions


def activity_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity_windows(views.read(spark, sf_dir, "events"))


def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(views.read(spark, sf_dir, "events"), "user_id", "6 hours")


def stream_sample_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of all documents as a stream: demultiplexed, trimmed and counted by sample."""
    schema = views.read(spark, sf_dir, "documents").schema
    documents = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.[p]arquet")  # as a pattern, as a stream's path is a folder otherwise
    reads = q.trim(q.demultiplex(views.reads_of(documents), barcodes(spark)))
    return run_available(sample_counts(reads), "sample-counts", "complete")


QUERIES = {"activity_hourly": activity_hourly, "activity_sessions": activity_sessions, "stream_sample_counts": stream_sample_counts}
SQL = {
    "activity_hourly": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "activity_sessions": """WITH o AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL 6 HOUR, true)::INT AS o FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS end, count(*) AS n FROM s GROUP BY user_id, s""",
    "stream_sample_counts": sql("reads", _DEMUX + _trim_sql("dm") + " SELECT sample, count(*) AS reads, count_if(NOT discarded)::BIGINT AS kept, coalesce(sum(CASE WHEN NOT discarded THEN length(cut) END), 0)::BIGINT AS bases, sum(bases_trimmed)::BIGINT AS bases_trimmed FROM t GROUP BY sample", "barcodes"),
}
