"""Differences of aligned pairs: columns, blocks and codon impact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helixframe.functions.sequence import translate_codons
from helixframe.functions.tables import RESIDUES
from helixframe.operators.scoring import MATRICES

BLOSUM = MATRICES["blosum62"]


def variant_columns(pairs: DataFrame) -> DataFrame:
    """(id, pos, ref, alt, kind) of each differing column of (id, ref_aligned, query_aligned)."""
    zipped = F.zip_with(F.split("ref_aligned", ""), F.split("query_aligned", ""), lambda r, q: F.struct(r.alias("ref"), q.alias("alt")))
    columns = pairs.select("id", F.posexplode(zipped).alias("pos", "c")).where("c.ref <> c.alt")
    return columns.select("id", "pos", "c.ref", "c.alt", F.when((F.col("c.ref") == "-") | (F.col("c.alt") == "-"), "Indel").otherwise("SNP").alias("kind"))


KINDS = ("equal", "insertion", "deletion", "substitution")
_GAP = ord("-")
#: Rows whose blocks are held at once.
ROWS = 256


def blocks_of(ref: str, query: str) -> list[tuple[int, str, str, str]]:
    """(start, ref, alt, kind) of each run of differing columns of one kind of two aligned rows."""
    r, q = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (ref, query))
    n = min(len(r), len(q))
    r, q = r[:n], q[:n]
    kind = np.where(r == q, 0, np.where(r == _GAP, 1, np.where(q == _GAP, 2, 3)))
    starts = np.flatnonzero(np.diff(kind, prepend=-1))
    ends = np.append(starts, n)[1:]
    before = np.cumsum(r != _GAP) - (r != _GAP)
    return [(int(before[s]), ref[s:e].replace("-", ""), query[s:e].replace("-", ""), KINDS[kind[s]]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if kind[s]]


def mutation_blocks(pairs: DataFrame) -> DataFrame:
    """(id, start, end, ref, alt, kind, notation): runs of columns of one kind, in bases of the ungapped reference.

    Row by row in Arrow batches, without a shuffle. Null rows have no blocks; of rows of unlike length the shorter counts.
    """

    return _noted(_blocks(pairs, None)).select("id", "start", "end", "ref", "alt", "kind", "notation")


def _blocks(pairs: DataFrame, frame: int | None) -> DataFrame:
    """(id, start, ref, alt, kind, codons) of each block; ``codons`` are the reference's bases of all codons in ``frame``
    that the block touches, null without a frame. A batch's rows are given on a few at a time."""
    types = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                found = [codons_of(r or "", blocks_of(r or "", q or ""), frame) for r, q in zip(batch.column("r").to_pylist(), batch.column("q").to_pylist(), strict=True)]
                ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found])))
                cells = list(zip(*(x for f in found for x in f), strict=True)) or [()] * len(types)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cells, types, strict=True))], ["id", "start", "ref", "alt", "kind", "codons"])

    rows = pairs.select("id", F.col("ref_aligned").cast("string").alias("r"), F.col("query_aligned").cast("string").alias("q"))
    return rows.mapInArrow(run, StructType([rows.schema["id"], *StructType.fromDDL("start int, ref string, alt string, kind string, codons string").fields]))


def codons_of(ref_aligned: str, blocks: list[tuple[int, str, str, str]], frame: int | None) -> list[tuple]:
    """The blocks with the reference's bases of the codons that each touches; none before the frame."""
    if frame is None:
        return [(*b, None) for b in blocks]
    dna, out = ref_aligned.replace("-", ""), []
    for start, ref, alt, kind in blocks:
        first = (start - frame) // 3
        last = max((start + len(ref) - 1 - frame) // 3, first)
        out.append((start, ref, alt, kind, dna[3 * first + frame : 3 * last + 3 + frame] if first >= 0 else ""))
    return out


def _noted(blocks: DataFrame) -> DataFrame:
    """``blocks`` with their ``end`` and notation."""
    end = F.col("start") + F.length("ref")
    one = F.length("ref") == 1
    notation = F.when(F.col("kind") == "substitution", F.concat((F.col("start") + 1).cast("string"), "ref", F.lit(">"), "alt"))
    notation = notation.when(F.col("kind") == "insertion", F.concat(F.col("start").cast("string"), F.lit("_"), (F.col("start") + 1).cast("string"), F.lit("ins"), "alt"))
    notation = notation.otherwise(F.concat((F.col("start") + 1).cast("string"), F.when(one, "").otherwise(F.concat(F.lit("_"), end.cast("string"))), F.lit("del"), "ref"))
    return blocks.withColumns({"end": end, "notation": notation})


def mutation_impacts(pairs: DataFrame, frame: int = 0) -> DataFrame:
    """``codon_impact`` of the ``mutation_blocks`` of aligned pairs, row by row: each block carries its own codons, so no
    row is joined with its sequence again."""
    blocks = _noted(_blocks(pairs, frame)).select("id", "start", "end", "ref", "alt", "kind", "notation", "codons")
    return _judged(blocks, frame).drop("codons")


def is_transition() -> F.Column:
    purines = F.col("ref").isin("A", "G") & F.col("alt").isin("A", "G")
    return purines | (F.col("ref").isin("C", "T", "U") & F.col("alt").isin("C", "T", "U"))


def codon_impact(blocks: DataFrame, references: DataFrame, frame: int = 0) -> DataFrame:
    """``blocks`` with ``impact``, ``protein`` (p.F1Y, of all codons that a substitution touches) and ``severity``.

    A substitution is judged by the residues of its codons before and after: unknown where the last codon is not whole,
    synonymous, nonsense (a stop comes in) or missense; an insertion or deletion by its length. ``severity`` is the
    BLOSUM62 score of a missense change of one residue, else 0. ``references``: (id, ref) ungapped, coding from ``frame``.
    """
    b = blocks.join(references.select("id", F.col("ref").alias("dna")), "id")
    at, n = _codons(frame)
    return _judged(b.withColumn("codons", F.substring(F.col("dna"), at + 1, n)).drop("dna"), frame).select(*blocks.columns, "impact", "protein", "severity")


def _codons(frame: int) -> tuple[F.Column, F.Column]:
    """First base and number of bases of the codons that a block touches."""
    first = F.floor((F.col("start") - frame) / 3).cast("int")
    last = F.greatest(F.floor((F.col("start") + F.length("ref") - 1 - frame) / 3).cast("int"), first)
    return 3 * first + frame, 3 * (last - first + 1)


def _judged(b: DataFrame, frame: int) -> DataFrame:
    """Blocks with ``codons``, and impact, protein change and severity by them."""
    columns, (at, n) = b.columns, _codons(frame)
    b = b.withColumns({"at": at, "n": n}).withColumn("first", F.floor((F.col("at") - frame) / 3).cast("int")).withColumn("k", F.col("start") - F.col("at"))
    changed = F.concat(F.expr("substring(codons, 1, k)"), F.col("alt"), F.expr("substring(codons, k + length(ref) + 1)"))
    b = b.withColumn("before", translate_codons(F.col("codons"))).withColumn("after", translate_codons(changed))
    before, after = F.col("before"), F.col("after")
    stops = F.contains(after, F.lit("*")) & ~F.contains(before, F.lit("*"))
    replaced = F.when(F.length("codons") < F.col("n"), "unknown").when(before == after, "synonymous").when(stops, "nonsense").otherwise("missense")
    indel = F.when(F.greatest(F.length("ref"), F.length("alt")) % 3 == 0, "inframe").otherwise("frameshift")
    b = b.withColumn("impact", F.when(F.col("start") < frame, "nonCoding").when(F.col("kind") == "substitution", replaced).otherwise(indel))
    protein = F.when(F.col("impact").isin("missense", "nonsense", "synonymous"), F.concat(F.lit("p."), before, (F.col("first") + 1).cast("string"), after))
    row, column = (F.nullif(F.instr(F.lit(RESIDUES), c), F.lit(0)) for c in (before, after))
    scores = F.array(*(F.lit(BLOSUM[x, y]) for x in RESIDUES for y in RESIDUES))
    severity = F.when((F.col("impact") == "missense") & (F.length("before") == 1), F.coalesce(F.get(scores, 20 * (row - 1) + column - 1), F.lit(0))).otherwise(0)
    return b.select(*columns, "impact", protein.alias("protein"), severity.alias("severity"))


def mutation_counts(blocks: DataFrame) -> DataFrame:
    """Counts by id: substitutions, insertions, deletions, transitions, transversions."""
    count = lambda c: F.count_if(c)
    sub = F.col("kind") == "substitution"
    return blocks.groupBy("id").agg(count(sub).alias("substitutions"), count(F.col("kind") == "insertion").alias("insertions"), count(F.col("kind") == "deletion").alias("deletions"), count(sub & is_transition()).alias("transitions"), count(sub & ~is_transition()).alias("transversions"))
