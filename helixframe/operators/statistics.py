"""Statistics of collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def describe(df: DataFrame, value: Column, by: str) -> DataFrame:
    """n, mean, median, population deviation, least and greatest of ``value`` for each ``by``."""
    aggregates = {"n": F.count("x"), "mean": F.avg("x"), "median": F.percentile("x", 0.5), "sd": F.stddev_pop("x"), "least": F.min("x"), "greatest": F.max("x")}
    return df.select(by, value.cast("double").alias("x")).groupBy(by).agg(*(F.round(c, 6).alias(k) if k != "n" else c.alias(k) for k, c in aggregates.items()))


def diversity(counts: DataFrame, by: str) -> DataFrame:
    """Shannon (base 2) and Simpson index of the symbol counts (by, symbol, n)."""
    share = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(by)))
    return share.groupBy(by).agg(F.round(F.sum(-F.col("p") * F.log2("p")), 6).alias("shannon"), F.round(1 - F.sum(F.col("p") * F.col("p")), 6).alias("simpson"))


def n50(lengths: DataFrame, by: str) -> DataFrame:
    """(by, n50, total): the length at which the longest sequences hold half of all bases.

    Equal lengths are counted first, so a window holds distinct lengths only.
    """
    counted = lengths.groupBy(by, "length").agg(F.sum("length").alias("bases"))
    down = Window.partitionBy(by).orderBy(F.desc("length"))
    running = counted.select(by, "length", F.sum("bases").over(down).alias("running"), F.sum("bases").over(Window.partitionBy(by)).alias("total"))
    return running.where("running * 2 >= total").groupBy(by).agg(F.max("length").alias("n50"), F.max("total").alias("total"))


def composition(sequences: DataFrame) -> DataFrame:
    """(symbol, n) of all sequences together: each task counts its own letters before anything is shuffled."""
    symbols = sequences.select(F.explode(F.split("seq", "")).alias("symbol")).where("symbol <> ''")
    return symbols.groupBy("symbol").agg(F.count("*").alias("n"))


def collection_report(sequences: DataFrame, gc: Column) -> DataFrame:
    """One row: number of sequences, mean, median, deviation and bounds of length and GC, diversity of all symbols.

    An empty collection has zeros.
    """
    both = sequences.select(F.length("seq").cast("double").alias("length"), gc.alias("gc"))
    makers = {"mean": F.avg, "median": lambda c: F.percentile(c, 0.5), "sd": F.stddev_pop, "least": F.min, "greatest": F.max}
    stats = both.agg(F.count("*").alias("n"), *(F.round(F.coalesce(f(c), F.lit(0.0)), 6).alias(f"{c}_{k}") for c in ("length", "gc") for k, f in makers.items()))
    index = diversity(composition(sequences).withColumn("all", F.lit(1)), "all")
    return stats.withColumn("all", F.lit(1)).join(index, "all", "left").drop("all").fillna(0.0)
