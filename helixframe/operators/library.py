"""The library of sequences: projects, upserts, features and the bounded log, as DataFrame helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_PROJECT = "default"


def in_project(sequences: DataFrame, project: str | None) -> DataFrame:
    """The sequences of a project; those without one are the default project's."""
    return sequences.where(F.coalesce("project_id", F.lit(DEFAULT_PROJECT)) == (project or DEFAULT_PROJECT))


def owned(records: DataFrame, user: str | None, admin: bool = False) -> DataFrame:
    """The records of a user; an administrator sees all, nobody sees nothing."""
    return records if admin else records.where(F.col("owner_id") == F.lit(user))


def delete_project(sequences: DataFrame, project: str) -> DataFrame:
    """The sequences left when a project goes with its own; the default one cannot."""
    if project == DEFAULT_PROJECT:
        raise ValueError("the default project stays")
    return sequences.where(F.coalesce("project_id", F.lit(DEFAULT_PROJECT)) != project)


def move(sequences: DataFrame, ids: DataFrame, project: str) -> DataFrame:
    """The sequences, those with an ``id`` in ``ids`` now in ``project``; a repeated id moves once."""
    moved = sequences.join(ids.select("id").distinct().withColumn("_moved", F.lit(True)), "id", "left")
    return moved.withColumn("project_id", F.when(F.col("_moved"), F.lit(project)).otherwise(F.col("project_id"))).select(sequences.columns)


def upsert(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``store`` with ``rows`` put in by key: new keys are added, old ones replaced."""
    return store.join(rows.select(key).distinct(), key, "left_anti").select(store.columns).unionByName(rows.select(store.columns))


def last_entries(log: DataFrame, by: str, most: int = 100) -> DataFrame:
    """The ``most`` latest entries, ties by ``by``: a top-k, so no task sorts the whole log."""
    return log.orderBy(F.desc("ts"), by).limit(most)


def count_by(records: DataFrame, by: str) -> DataFrame:
    return records.groupBy(by).agg(F.count("*").alias("n"))


def features(orfs: DataFrame, mutations: DataFrame, least: int = 150, top: int = 40) -> DataFrame:
    """(doc_id, kind, start, end, strand): the ``top`` longest frames of ``least`` bases, and mutations, at least one base wide."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("length"), "strand", "frame", "start"))
    frames = orfs.where(F.col("length") >= least).withColumn("r", rank).where(F.col("r") <= top).select("doc_id", F.lit("orf").alias("kind"), F.col("forward_start").alias("start"), (F.col("forward_start") + F.col("length")).alias("end"), "strand")
    kind = F.when(F.col("kind") == "substitution", "snp").otherwise(F.col("kind"))
    changes = mutations.select(F.col("id").alias("doc_id"), kind.alias("kind"), "start", F.greatest(F.col("end"), F.col("start") + 1).alias("end"), F.lit("+").alias("strand"))
    return frames.unionByName(changes)
