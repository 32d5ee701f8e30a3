"""Contig assembly of any number of reads: an overlap graph that is contracted round by round.

A contig overlaps another where its last letters stand in the other, or in its reverse complement: an equi-join of tails
and k-mers gives these pairs, and the overlap itself is found in Arrow batches. An edge that is the best at both of the ends
it joins is one that the greedy rule takes whatever else is merged; of these a random matching is contracted in each
round, so a chain of reads shrinks by a share of its length. Only edges of changed contigs are looked for again. Every
round is a written table, and no sample is held in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.sequence import complement, kmers
from helixframe.operators.annotation import coverage
from helixframe.operators.families import overlap_matches
from helixframe.operators.storage import materialise, spread

PLACED = "array<struct<idx: long, start: int, end: int, reversed: boolean>>"


def best_overlap(a: str, b: str, least: int, identity: float) -> int:
    """The longest overlap of a's end and b's start of ``least`` letters or more that agrees in ``identity`` percent; 0 without."""
    matches = np.array(overlap_matches(a, b), np.int64)
    n = np.arange(len(matches))
    fits = np.flatnonzero((n >= max(1, least)) & (100.0 * matches >= identity * n))
    return int(fits[-1]) if len(fits) else 0


def _turned(seq: Column) -> Column:
    return F.reverse(complement(F.translate(seq, "U", "T")))


def _edges(left: DataFrame, right: DataFrame, k: int, least: int, identity: float) -> DataFrame:
    """(family_id, a, b, rev, n, weight): overlaps of the ends of contigs in ``left`` with the starts of those in ``right``."""

    @F.pandas_udf("struct<n: int, weight: double>")
    def overlap(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        found = []
        for a, b in zip(x, y, strict=True):
            n = best_overlap(a, b, least, identity)
            same = sum(p == q for p, q in zip(a[len(a) - n :], b[:n], strict=True)) if n else 0
            found.append((n, n * (100.0 * same / n) if n else 0.0))
        return pd.DataFrame(found, columns=["n", "weight"])

    tails = left.where(F.length("seq") >= k).select("family_id", F.col("id").alias("a"), F.xxhash64(F.expr(f"right(seq, {k})")).alias("gram"))
    both = F.array(F.struct(F.lit(False).alias("rev"), F.col("seq").alias("s")), F.struct(F.lit(True).alias("rev"), _turned(F.col("seq")).alias("s")))
    grams = right.select("family_id", F.col("id").alias("b"), F.explode(both).alias("o")).select("family_id", "b", "o.rev", F.explode(F.array_distinct(kmers(F.col("o.s"), k))).alias("gram")).withColumn("gram", F.xxhash64("gram"))
    pairs = tails.join(grams, ["family_id", "gram"]).where("a <> b").select("family_id", "a", "b", "rev").distinct()
    own = left.select("family_id", F.col("id").alias("a"), F.col("seq").alias("a_seq"))
    other = right.select("family_id", F.col("id").alias("b"), F.col("seq").alias("b_seq"))
    pairs = spread(pairs.join(own, ["family_id", "a"]).join(other, ["family_id", "b"]), "family_id", "a", "b", "rev")
    turned = F.when(F.col("rev"), _turned(F.col("b_seq"))).otherwise(F.col("b_seq"))
    pairs = pairs.withColumn("b_seq", turned).where(F.contains(F.col("b_seq"), F.expr(f"right(a_seq, {k})")))
    return pairs.withColumn("o", overlap("a_seq", "b_seq")).where("o.n > 0").select("family_id", "a", "b", "rev", "o.n", "o.weight")


def assemble_reads(reads: DataFrame, min_overlap: int = 20, identity: float = 90.0) -> DataFrame:
    """(family_id, contig_id, contig, n_reads, placements) of the reads (family_id, idx, seq), the longest contig of each
    family first, ties by its first read.

    The overlap with the greatest length times identity is merged first, ties by the lowest reads, forward first; the
    left contig's letters stand in the overlap. ``placements`` lists (idx, start, end, reversed) by start. Null and blank
    reads are left out; idx is taken as unique in its family; a null family is one; extra columns are ignored; an empty
    table gives an empty result.
    """
    k = min(12, min_overlap)
    named = reads.where(F.trim("seq") != "").select(F.coalesce(F.col("family_id").cast("string"), F.lit("")).alias("family_id"), F.col("family_id").cast("long").alias("family"), F.col("idx").cast("long").alias("id"), "seq")
    families = materialise(named.select("family_id", "family").distinct(), "families")
    start = F.array(F.struct(F.col("id").alias("idx"), F.lit(0).alias("start"), F.length("seq").alias("end"), F.lit(False).alias("reversed")))
    contigs = materialise(named.select("family_id", "id", "seq", start.alias("placed")), "contigs")
    edges = materialise(_edges(contigs, contigs, k, min_overlap, identity), "overlaps")
    while True:
        used = F.array(F.struct(F.col("a").alias("id"), F.lit(True).alias("tail")), F.struct(F.col("b").alias("id"), F.col("rev").alias("tail")))
        rank = F.struct("weight", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"), (~F.col("rev")).alias("forward"))
        best = edges.withColumn("end", F.explode(used)).groupBy("family_id", "end").agg(F.max(F.struct(rank.alias("rank"), "n")).alias("m"))
        best = best.groupBy("family_id", (-F.col("m.rank.a")).alias("a"), (-F.col("m.rank.b")).alias("b"), (~F.col("m.rank.forward")).alias("rev"), "m.n").agg(F.count("*").alias("ends")).where("ends = 2").drop("ends")
        lot = F.struct(F.xxhash64("family_id", "a", "b", "rev").alias("h"), "a", "b", "rev", "n")  # of edges that meet at a contig one is contracted in a round
        drawn = best.withColumn("at", F.explode(F.array("a", "b"))).groupBy("family_id", "at").agg(F.max(lot).alias("m"))
        drawn = drawn.groupBy("family_id", "m.a", "m.b", "m.rev", "m.n").agg(F.count("*").alias("ends")).where("ends = 2").drop("ends")
        chosen = materialise(drawn, "chosen-overlaps")
        if chosen.isEmpty():
            break
        left = contigs.withColumnsRenamed({"id": "a", "seq": "a_seq", "placed": "a_placed"})
        right = contigs.withColumnsRenamed({"id": "b", "seq": "b_seq", "placed": "b_placed"})
        joined = chosen.join(left, ["family_id", "a"]).join(right, ["family_id", "b"])
        size, shift = F.length("b_seq"), F.length("a_seq") - F.col("n")
        flipped = F.transform("b_placed", lambda p: F.struct(p["idx"].alias("idx"), F.when(F.col("rev"), size - p["end"]).otherwise(p["start"]).alias("start"), F.when(F.col("rev"), size - p["start"]).otherwise(p["end"]).alias("end"), (p["reversed"] != F.col("rev")).alias("reversed")))
        moved = F.transform(flipped, lambda p: F.struct(p["idx"].alias("idx"), (p["start"] + shift).alias("start"), (p["end"] + shift).alias("end"), p["reversed"].alias("reversed")))
        turned = F.when(F.col("rev"), _turned(F.col("b_seq"))).otherwise(F.col("b_seq"))
        merged = joined.select("family_id", F.col("a").alias("id"), F.concat(F.col("a_seq"), F.substring(turned, F.col("n") + 1, F.length("b_seq"))).alias("seq"), F.concat("a_placed", moved).alias("placed"))
        changed = chosen.select("family_id", F.explode(F.array("a", "b")).alias("id"))
        merged = materialise(merged, "merged-contigs")
        still = contigs.join(changed, ["family_id", "id"], "left_anti")
        contigs = materialise(still.unionByName(merged), "contigs")
        kept = edges.join(changed.withColumnRenamed("id", "a"), ["family_id", "a"], "left_anti").join(changed.withColumnRenamed("id", "b"), ["family_id", "b"], "left_anti")
        others = contigs.join(merged.select("family_id", "id"), ["family_id", "id"], "left_anti")
        found = _edges(merged, contigs, k, min_overlap, identity).unionByName(_edges(others, merged, k, min_overlap, identity))
        edges = materialise(kept.unionByName(found), "overlaps")
    order = Window.partitionBy("family_id").orderBy(F.desc(F.length("seq")), "id")
    numbered = contigs.withColumn("contig_id", F.row_number().over(order) - 1)
    placed = F.array_sort("placed", lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(F.signum(x["idx"] - y["idx"]).cast("int"))).cast(PLACED)
    return numbered.join(families, "family_id").select(F.col("family").alias("family_id"), "contig_id", F.col("seq").alias("contig"), F.size("placed").alias("n_reads"), placed.alias("placements"))


def contig_coverage(contigs: DataFrame) -> DataFrame:
    """(family_id, contig_id, start, end, depth): stretches of one read depth, of each contig from its placements."""
    key = F.struct("family_id", "contig_id").alias("contig")
    return coverage(contigs.select(key, F.explode("placements").alias("p")).select("contig", "p.start", "p.end"), "contig").select("contig.family_id", "contig.contig_id", "start", "end", "depth")
