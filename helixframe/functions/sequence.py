"""Column functions of nucleotide sequences, linear in the sequence: Catalyst expressions, and Arrow functions for codons and runs."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.functions.letters import longest_run, residues_of_codons

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_upper(s: Column) -> Column:
    return F.translate(s, LOWER, UPPER)


def count_of(s: Column, letter: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(letter), F.lit("")))


def sanitize(s: Column) -> Column:
    """A-Z, ``*`` and ``-`` of the upper-cased text."""
    return F.regexp_replace(ascii_upper(s), "[^A-Z*-]", "")


def detect_type(s: Column) -> Column:
    nucleic = s.rlike(r"^[ACGTUN\-\s]+$")
    return F.when(s == "", "unknown").when(nucleic & (count_of(s, "U") > count_of(s, "T")), "rna").when(nucleic, "dna").otherwise("protein")


def complement(s: Column, rna: bool = False) -> Column:
    return F.translate(s, "ACGTU", "UGCAA") if rna else F.translate(s, "ACGT", "TGCA")


def reverse_complement(s: Column, rna: bool = False) -> Column:
    return F.reverse(complement(s, rna))


def percent_of(s: Column, letters: str) -> Column:
    return F.when(F.length(s) == 0, 0.0).otherwise(reduce(add, (count_of(s, x) for x in letters)) * 100.0 / F.length(s))


def gc_content(s: Column) -> Column:
    return percent_of(s, "GC")


def at_content(s: Column) -> Column:
    return percent_of(s, "ATU")


def translate_codons(s: Column) -> Column:
    """Protein of frame 1: stops are ``*``, unknown codons X, a rest of one or two bases is dropped."""
    return residues_of_codons(s)


def kmers(s: Column, k: int) -> Column:
    """Array of all ``k``-mers, repeats included; empty where the sequence is shorter."""
    return F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def transcribe_coding(s: Column) -> Column:
    return F.translate(s, "T", "U")


def transcribe_template(s: Column) -> Column:
    return F.translate(reverse_complement(s), "T", "U")


def poly_a_tail(s: Column) -> Column:
    return F.length(s) - F.length(F.rtrim(s, F.lit("A")))


def longest_m_segment(protein: Column) -> Column:
    """Length from the first M of a stop-free segment to its end, the longest."""
    return F.array_max(F.transform(F.split(protein, "[*]"), lambda x: F.when(F.instr(x, "M") > 0, F.length(x) - F.instr(x, "M") + 1).otherwise(0)))


def rna_class(length: Column, orf: Column, poly_a: Column) -> tuple[Column, Column]:
    """(class, confidence) from length, longest open frame in residues and poly-A tail."""
    rules = [
        (length.between(18, 26), "miRNA", F.lit(55)),
        (length.between(60, 100), "tRNA", F.lit(40)),
        (length.between(100, 135) | length.between(1400, 1650) | length.between(2700, 3100), "rRNA", F.lit(38)),
        ((orf >= 30) & (length > 200), "mRNA", F.when(poly_a >= 10, 75).otherwise(55)),
        (length > 200, "lncRNA", F.lit(35)),
        (length.between(20, 30) & (orf < 30), "siRNA", F.lit(25)),
    ]
    kind, confidence = F.lit("unknown"), F.lit(15)
    for when, name, value in reversed(rules):
        kind, confidence = F.when(when, name).otherwise(kind), F.when(when, value).otherwise(confidence)
    return kind, confidence


def melting_temperature(s: Column) -> Column:
    """Wallace rule below 14 bases, GC formula from there on; 0 where empty."""
    n, gc = F.length(s), F.length(F.regexp_replace(s, "[^GC]", ""))
    short = 2.0 * F.length(F.regexp_replace(s, "[^AT]", "")) + 4.0 * gc
    return F.when(n == 0, 0.0).when(n < 14, short).otherwise(81.5 + 0.41 * (gc * 100.0 / n) - 675.0 / n)


def has_repeat(s: Column, run: int = 5) -> Column:
    return s.rlike("|".join(f"{b}{{{run},}}" for b in "ATGC"))


def longest_homopolymer(s: Column) -> Column:
    return F.coalesce(longest_run(s), F.lit(0))


def stability_temperature(s: Column) -> Column:
    n = F.length(s)
    return F.when(n > 0, 64.9 + 41 * (gc_content(s) / 100 * n - 16.4) / n)


def thermal_stability(gc: Column) -> Column:
    return F.when(gc >= 60, "Thermally stable (GC-rich)").when(gc >= 40, "Moderate stability").otherwise("Lower thermal stability (AT-rich)")


def hamming(a: Column, b: Column) -> Column:
    """Places in which two strings of one length differ."""
    return F.size(F.filter(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y")), lambda z: z["x"] != z["y"]))
