"""Open reading frames, intervals and annotation lines.

Frames are read in Arrow batches: a strand's codons are looked up as one numpy array, and stops and starts are found by
searches in their sorted places, so a sequence costs the same few array steps whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from helixframe.functions.letters import AMINO, BASE, parts

#: Rows of one Arrow batch that are worked at once.
BATCH = 256
_TURNED = np.array([2, 3, 0, 1, 4], np.uint8)  # T, C, A, G: each base's complement
_EVENT = np.where(AMINO == ord("M"), 1, np.where(AMINO == ord("*"), 2, 0)).astype(np.uint8)
_SIGN = pa.array(["+", "-"])


def _strands(seq: str) -> list[tuple[str, np.ndarray]]:
    """Amino letters of the codon at every place of both strands (X where it holds anything but bases)."""
    own = BASE[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    out = []
    for strand, b in (("+", own), ("-", _TURNED[own[::-1]])):
        if len(b) < 3:
            out.append((strand, np.zeros(0, np.uint8)))
            continue
        out.append((strand, AMINO[25 * b[:-2] + 5 * b[1:-1] + b[2:]]))
    return out


def frame_segments(amino: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first M, end, whether a stop ends it) of each stop-free segment of a frame that holds an M, in residues."""
    stops = np.flatnonzero(amino == ord("*"))
    starts = np.flatnonzero(amino == ord("M"))
    ends = np.append(stops, len(amino))
    begins = np.concatenate([[0], stops + 1])
    k = np.searchsorted(starts, begins)
    first = np.append(starts, len(amino))[k]
    has = first < ends
    return first[has], ends[has], (np.arange(len(ends)) < len(stops))[has]


def orf_rows(seqs: list[str], min_length: int, top: int | None) -> np.ndarray:
    """Rows number of the sequence, minus (0 or 1), frame, start, end, n_aa and rank of the frames of all sequences, by
    sequence and the longest first.

    Stops and Ms of a part are put in order of sequence, strand, frame and place: a frame begins at an M that follows a stop
    or comes first, and ends at the next stop.
    """
    found, before = [np.zeros((7, 0), np.int64)], 0
    for codes, places in parts(seqs):
        base = BASE[codes if codes.dtype == np.uint8 else np.minimum(codes, 255)]
        strands = [_strand_frames(b, own, min_length) for b, own in ((base, places), (_TURNED[base[::-1]], places[-1] - places[::-1]))]
        strands[1][0] = len(places) - 2 - strands[1][0]  # turned around, the last sequence is the first
        rows = np.concatenate([np.insert(own, 1, minus, axis=0) for minus, own in enumerate(strands)], axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], rows[1], rows[3] - rows[4], rows[0]))]
        rank = np.arange(1, rows.shape[1] + 1) - np.searchsorted(rows[0], rows[0])
        rows = np.concatenate([rows, rank[None]])
        rows[0] += before
        found.append(rows if top is None else rows[:, rank <= top])
        before += len(places) - 1
    return np.concatenate(found, axis=1)


def _strand_frames(base: np.ndarray, places: np.ndarray, min_length: int) -> np.ndarray:
    """Rows number of the sequence, frame, start, end and n_aa of the frames of one strand of sequences one after another."""
    event = _EVENT[25 * base[:-2] + 5 * base[1:-1] + base[2:]]
    at = np.flatnonzero(event)
    own = np.searchsorted(places, at, "right") - 1
    whole = at + 3 <= places[own + 1]
    at, own = at[whole], own[whole]
    group = 3 * own + (at - places[own]) % 3
    order = np.argsort(group, kind="stable")
    at, own, group = at[order], own[order], group[order]
    stop = event[at] == 2
    stops = np.flatnonzero(stop)
    first = ~stop
    first[1:] &= stop[:-1] | (group[1:] != group[:-1])
    start = np.flatnonzero(first)
    end = np.append(stops, -1)[np.searchsorted(stops, start)]
    has = (end >= 0) & (group[end] == group[start])
    start, end = start[has], end[has]
    length = at[end] + 3 - at[start]
    start, end, length = (x[length >= min_length] for x in (start, end, length))
    begin = places[own[start]]
    return np.stack([own[start], group[start] % 3, at[start] - begin, at[end] + 3 - begin, length // 3 - 1])


def orf_columns(seq: str, min_length: int, top: int | None) -> list[np.ndarray]:
    """Columns minus (0 or 1), frame, start, end, n_aa of a sequence's frames, the longest first."""
    return list(orf_rows([seq], min_length, top)[1:6])


def find_orfs(sequences: DataFrame, min_length: int = 100, top: int | None = 200) -> DataFrame:
    """Frames from ATG to the first stop, stop included, of ``min_length`` bases or more; the ``top`` longest of each
    (None: all), ties by strand, frame and start.

    Start and end are places on the frame's own strand; forward_start is the leftmost base on the plus strand. Frames
    without a stop do not count. Null, empty and shorter sequences have none; repeated rows each give their frames.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                seqs = [s or "" for s in part.column("seq").to_pylist()]
                row, minus, frame, start, end, n_aa, rank = orf_rows(seqs, min_length, top)
                forward = np.where(minus == 1, np.array([len(s) for s in seqs])[row] - end, start)
                ints = [pa.array(x.astype(np.int32)) for x in (frame, start, end, end - start, n_aa, forward, rank)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), _SIGN.take(pa.array(minus)), *ints], ["doc_id", "strand", "frame", "start", "end", "length", "n_aa", "forward_start", "rank"])

    own = sequences.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("seq").cast("string").alias("seq"))
    return own.mapInArrow(run, "doc_id long, strand string, frame int, start int, end int, length int, n_aa int, forward_start int, rank int")


def best_segment(seq: str) -> tuple[str, int, str]:
    """(strand, frame, residues) of the longest segment from M; ties forward first, then lower frame, then first in it."""
    scored = []
    for strand, amino in _strands(seq):
        for frame in range(3):
            own = amino[frame::3]
            first, end, _ = frame_segments(own)
            k = int((end - first).argmax()) if len(first) else None
            segment = own[:0] if k is None else own[first[k] : end[k]]
            scored.append((-len(segment), strand, frame, segment.tobytes().decode()))
    return min(scored)[1:]


def _best(sequences: DataFrame, columns, schema: str) -> DataFrame:
    """doc_id and ``columns(sequence)`` of each row, in Arrow batches."""
    names, kinds = zip(*(field.split() for field in schema.split(", ")), strict=True)
    types = [{"string": pa.string(), "int": pa.int32()}[kind] for kind in kinds]

    def run(batches):
        for batch in batches:
            rows = [columns(s or "") for s in batch.column("seq").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], ["doc_id", *names])

    own = sequences.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("seq").cast("string").alias("seq"))
    return own.mapInArrow(run, "doc_id long, " + schema)


def best_frame(sequences: DataFrame) -> DataFrame:
    """(doc_id, strand, frame, longest): the frame with the longest segment from M; ties forward first, then lower.

    A segment may run to the sequence's end. Null and empty sequences give the first frame with 0.
    """

    def columns(seq: str) -> tuple:
        strand, frame, residues = best_segment(seq)
        return strand, frame, len(residues)

    return _best(sequences, columns, "strand string, frame int, longest int")


def best_proteins(sequences: DataFrame) -> DataFrame:
    """(doc_id, strand, frame, protein): the residues of that segment, and where no frame holds an M the whole translation of
    the first one, stops included. Null and empty sequences give an empty protein.
    """

    def columns(seq: str) -> tuple:
        strand, frame, residues = best_segment(seq)
        return strand, frame, residues or _strands(seq)[0][1][::3].tobytes().decode()

    return _best(sequences, columns, "strand string, frame int, protein string")


def gff3_lines(features: DataFrame) -> DataFrame:
    """(doc_id, line): a GFF3 line for each ORF."""
    note = F.replace(F.url_encode(F.concat(F.lit("ORF of "), F.col("n_aa").cast("string"), F.lit(" aa"))), F.lit("+"), F.lit("%20"))
    start = F.col("forward_start")
    fields = [F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.lit("helixframe"), F.lit("ORF"), (start + 1).cast("string"), (start + F.col("length")).cast("string"), F.lit("."), F.col("strand"), F.lit("0"), F.concat(F.lit("Note="), note)]
    return features.select("doc_id", F.concat_ws("\t", *fields).alias("line"))


def coverage(intervals: DataFrame, by: str) -> DataFrame:
    """(by, start, end, depth): stretches of one depth over the half-open ``start`` to ``end`` of each ``by``."""
    events = intervals.select(by, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("e")).groupBy(by, F.col("e.at").alias("start")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(by).orderBy("start")
    return events.select(by, "start", F.lead("start").over(w).alias("end"), F.sum("d").over(w).alias("depth")).where("depth > 0")


def max_lanes(intervals: DataFrame, by: str) -> DataFrame:
    """(by, lanes): lanes that a drawing without overlaps needs: the greatest depth."""
    return coverage(intervals, by).groupBy(by).agg(F.max("depth").alias("lanes"))


class _Lanes:
    """Lanes of one sequence's intervals in order of their start: a heap of taken lanes by end, one of free lanes."""

    def __init__(self) -> None:
        self.taken: list[tuple[int, int]] = []
        self.free: list[int] = []

    def place(self, start: int, end: int) -> int:
        while self.taken and self.taken[0][0] <= start:
            heappush(self.free, heappop(self.taken)[1])
        lane = heappop(self.free) if self.free else len(self.taken)
        heappush(self.taken, (end, lane))
        return lane


def lanes(intervals: DataFrame, by: str, name: str) -> DataFrame:
    """(by, name, start, end, lane): for each half-open interval the first lane that is free at its start, by start and name.

    Intervals are dealt and sorted by sequence and start, and a task carries the taken lanes from batch to batch, so a
    sequence of any size needs memory for its greatest depth only. A null start or end has no lane; null sequences are one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, _Lanes()
        for batch in batches:
            out = []
            for at, start, end in zip(*(batch.column(c).to_pylist() for c in (by, "start", "end")), strict=True):
                if (at,) != key:
                    key, own = (at,), _Lanes()
                out.append(None if start is None or end is None else own.place(start, end))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], [*batch.schema.names, "lane"])

    rows = intervals.select(by, name, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    schema = StructType([*rows.schema.fields, StructField("lane", IntegerType())])
    return rows.repartition(by).sortWithinPartitions(by, "start", name).mapInArrow(run, schema)
