"""Best-fit packing by minimum bin slack (operator 4).

The plan works on the histogram of piece lengths (at most ``capacity`` rows, whatever the corpus): the longest length
left opens a bin, and a bitset subset-sum over the lengths left finds the fullest combination with it. As the choice
depends only on which lengths are left, the same combination is used again while the counts allow, so the plan's size
and time do not grow with the number of bins. Documents then find their place by a join on (length, rank).
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import map_batches, materialise
from helixframe.llm.tokenizer_memo import WordIds, encoder

#: Ranks within a length are dealt to so many buckets, so that a hot length is not ranked in one task.
RANK_BUCKETS = 256

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Cut each document's ids (the end id appended) into pieces of at most ``capacity``."""
    size = 4 * capacity
    end = end_id.to_bytes(4, "little")

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, rows = batch.column("doc_id").to_pylist(), []
        for doc_id, data in zip(ids, encoder(WordIds, tokenizer_path)([t or "" for t in batch.column("text").to_pylist()]), strict=True):
            data += end
            for k, at in enumerate(range(0, len(data), size)):
                part = data[at : at + size]
                rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        columns = zip(*rows, strict=True) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), pieces, PIECES)


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """The combination of lengths (descending list) that fills most of ``room``: a bitset of reachable sums.

    Bit s of ``reach`` tells that s can be filled; a length that occurs c times is shifted in at most c times, in
    powers of two. The bitset before each shift is kept, to read the combination back.
    """
    full, mask = 1 << room, (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        if length > room:
            continue
        left, times = min(counts[length], room // length), 1
        while left > 0:
            times = min(times, left)
            steps.append((reach, length, times))
            reach |= (reach << (length * times)) & mask
            left -= times
            times *= 2
        if reach & full:
            break
    at, chosen = reach.bit_length() - 1, []
    for before, length, times in reversed(steps):
        if not before >> at & 1:
            chosen += [length] * times
            at -= length * times
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int = 4096) -> list[tuple[int, int, list[int]]]:
    """(first sequence, number of sequences, lengths in place order) for each combination used."""
    counts, plan, sequence = dict(histogram), [], 0
    lengths = sorted(counts, reverse=True)
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        chosen = [first, *fullest(counts, [x for x in lengths if counts[x]], capacity - first)]
        counts[first] += 1
        need: dict[int, int] = {}
        for x in chosen:
            need[x] = need.get(x, 0) + 1
        times = min(counts[x] // n for x, n in need.items())
        plan.append((sequence, times, chosen))
        sequence += times
        for x, n in need.items():
            counts[x] -= n * times
        lengths = [x for x in lengths if counts[x]]
    return plan


def _segments(plan: list[tuple[int, int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, copies in a sequence, first sequence, first offset) for each length of each step."""
    used: dict[int, int] = {}
    out = []
    for sequence, times, chosen in plan:
        offset = 0
        for length in dict.fromkeys(chosen):
            copies = chosen.count(length)
            rank = used.get(length, 0)
            out.append((length, rank, rank + copies * times, copies, sequence, offset))
            used[length] = rank + copies * times
            offset += copies * length
    return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is a piece of the end id alone. Repeated rows are packed as often as they occur, rows with a
    null doc_id like any other. Ties go by doc_id and piece. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, tokenizer_path, end_id, capacity).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_BUCKETS)).cast("int")), "pieces")
    cells = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = materialise(cells.select("length", "bucket", "n", before.alias("before")), "cells")
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    segments = spark.createDataFrame(_segments(plan_bins(histogram, capacity)), "length long, rank0 long, rank1 long, copies long, sequence0 long, offset0 long")
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
    ranked = pieces.withColumn("rank", rank).join(cells.select("length", "bucket", "before"), ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    # The plan's segments follow from the histogram's at most ``capacity`` lengths, not from the number of documents.
    placed = ranked.join(F.broadcast(segments), ["length"]).where((F.col("rank") >= F.col("rank0")) & (F.col("rank") < F.col("rank1")))
    place = F.col("rank") - F.col("rank0")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence0") + F.floor(place / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("offset0") + place % F.col("copies") * F.col("length")).cast("long").alias("offset"),
    )
