"""Numbers of distinct k-mers from sketches that are merged between groups, tables and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.sequence import kmers

#: Registers of a sketch, as a power of two: the standard error is 1.04 / sqrt(2^14), that is 0.8 percent, in some 16 KB.
REGISTERS = 14


def kmer_sketches(sequences: DataFrame, by: list[str], k: int = 11, registers: int = REGISTERS) -> DataFrame:
    """(by, sketch): a sketch of the distinct ``k``-mers of each group of (by, seq).

    Each task folds its k-mers into a sketch a group before anything is shuffled, so what moves grows with tasks and
    groups, not with letters, and a group of any size is no hot one. Null and short sequences add nothing; a group without
    k-mers has an empty sketch.
    """
    words = sequences.select(*by, F.explode_outer(F.array_distinct(kmers(F.col("seq"), k))).alias("kmer"))
    return words.groupBy(*by).agg(F.hll_sketch_agg("kmer", registers).alias("sketch"))


def merge_sketches(tables: list[DataFrame], by: list[str]) -> DataFrame:
    """One table of (by, sketch) from several, such as those of earlier runs; the result is as if made of all rows at once."""
    rows = tables[0]
    for table in tables[1:]:
        rows = rows.unionByName(table)
    return rows.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def kmer_cardinality(sketches: DataFrame, by: list[str], cube: bool = False) -> DataFrame:
    """(by, level, kmers): estimates for each group and its roll-ups (all combinations with ``cube``).

    ``level`` has a bit for each column that is rolled up, the last one lowest: it tells a null group from a total.
    """
    grouped = sketches.cube(*by) if cube else sketches.rollup(*by)
    return grouped.agg(F.grouping_id().cast("int").alias("level"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("kmers"))
