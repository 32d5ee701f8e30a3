"""Projections of sequences to coordinates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.protein import KINDS, structure_letters
from helixframe.functions.sequence import complement

#: Bases drawn of a helix by default.
HELIX_BASES = 120


def helix_atoms(sequences: DataFrame, most: int | None = HELIX_BASES) -> DataFrame:
    """(doc_id, strand, base_index, base, x, y, z): a double helix of radius 9, rise 3 and twist 34 degrees.

    The first ``most`` bases are drawn, with None all; null and empty sequences have no atoms.
    """
    drawn = F.col("seq") if most is None else F.substring("seq", 1, most)
    bases = sequences.select("doc_id", F.posexplode(F.split(drawn, "")).alias("base_index", "base")).where("base <> ''")
    strands = bases.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("strand"))
    angle = F.radians(34.0 * F.col("base_index") + 180.0 * (F.col("strand") - 1))
    base = F.when(F.col("strand") == 1, F.col("base")).otherwise(complement(F.col("base")))
    return strands.select("doc_id", "strand", "base_index", base.alias("base"), F.round(9 * F.cos(angle), 6).alias("x"), F.round(9 * F.sin(angle), 6).alias("y"), (3.0 * F.col("base_index")).cast("double").alias("z"))


def backbone(proteins: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, index, residue, kind, x, y, z): a point for each residue of (doc_id, seq), by its secondary structure.

    A helix winds on by 100 degrees and rises by 1.5, a sheet zigzags and rises by 3.2, a coil wanders and rises by 2.2.
    All residues are drawn, or the first ``most``; null and empty proteins have none. Row by row: nothing is shuffled.
    """
    drawn = proteins.select("doc_id", (F.col("seq") if most is None else F.substring("seq", 1, most)).alias("seq")).where("seq <> ''")
    placed = drawn.withColumn("letters", structure_letters(F.col("seq"))).withColumn("at", _along(F.col("letters")))
    points = F.arrays_zip(F.split("seq", "").alias("residue"), F.split("letters", "").alias("letter"), F.col("at.turn").alias("turn"), F.col("at.z").alias("z"))
    rows = placed.select("doc_id", F.posexplode(points).alias("index", "p")).select("doc_id", "index", "p.*").where("residue <> ''")
    i, kind = F.col("index"), F.element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), F.col("letter"))
    rows = rows.select("*", kind.alias("kind"), F.radians(100.0 * F.col("turn")).alias("angle"))
    kind = F.col("kind")
    x = F.when(kind == "Helix", 2.3 * F.cos("angle")).when(kind == "Sheet", F.when(i % 2 == 0, 1.6).otherwise(-1.6)).otherwise(2.5 * F.sin(0.5 * i))
    y = F.when(kind == "Helix", 2.3 * F.sin("angle")).when(kind == "Sheet", 0.0).otherwise(2.0 * F.cos(0.7 * i))
    return rows.select("doc_id", "index", "residue", F.lower("kind").alias("kind"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round("z", 6).alias("z"))


def _along(letters: Column) -> Column:
    """Struct of the place of each residue in its run of one class, and of the height that it has risen to."""
    rises = np.zeros(256)
    for letter, kind in KINDS.items():
        rises[ord(letter)] = {"Helix": 1.5, "Sheet": 3.2}.get(kind, 2.2)

    @F.arrow_udf("struct<turn: array<int>, z: array<double>>")
    def run(own: pa.Array) -> pa.Array:
        texts = [x or "" for x in own.to_pylist()]
        ends = np.cumsum([0, *map(len, texts)])
        codes, at = np.frombuffer("".join(texts).encode(), np.uint8), np.arange(ends[-1])
        heads = np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)]
        heads[ends[:-1][ends[:-1] < len(codes)]] = True
        turn = (at - np.maximum.accumulate(np.where(heads, at, 0))).astype(np.int32)
        z = np.concatenate([np.zeros(0), *(np.cumsum(rises[codes[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True))])
        ends = pa.array(ends.astype(np.int32))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(turn)), pa.ListArray.from_arrays(ends, pa.array(z))], ["turn", "z"])

    return run(letters)
