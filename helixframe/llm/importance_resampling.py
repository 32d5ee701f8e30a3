"""Target-distribution importance resampling (operator 12).

Documents are scored against the benchmark by hashed word features: one pass counts each text's features in an array of
buckets and writes the buckets, a second adds them up over the table, a third takes the mean gain of each document from
an array of gains. The highest scores are drawn by weighted median-of-medians selection: every partition reports the
medians of its remaining keys with their number, the weighted median of these splits the keys so that a quarter at least
goes each round, and the exact cutoff key is found without sorting the table. Only the winners are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import ROW, map_batches, materialise, new_table_path

#: ASCII other than letters and digits parts words; A-Z are lower-cased.
_FOLD = bytes(c if c >= 128 or 48 <= c < 58 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
#: Keys left of the selection that are sorted on the driver (24 bytes each).
LAST = 4096
BUCKETS = 10_000


def features(text: bytes | None, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """(number of words, bucket of each run of one and of two words) of a text in UTF-8."""
    words = (text or b"").translate(_FOLD).split()
    single = list(map(zlib.crc32, words))
    paired = [zlib.crc32(b" " + w, c) for w, c in zip(words[1:], single, strict=False)]
    return len(words), (np.array(single + paired, np.uint32) % np.uint32(buckets)).astype("<u2")


def _featured(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and (n_words, buckets) of each row's text, written."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t) for t in batch.column("text").to_pylist()]
        own = [pa.array([n for n, _ in found], pa.int64()), pa.array([b.tobytes() for _, b in found], pa.binary())]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *own], [*keep, "n_words", "buckets"])

    texts = rows.select(*keep, F.col("text").cast("string").cast("binary").alias("text"))
    return materialise(map_batches(texts, run, ", ".join([*(f"{c} long" for c in keep), "n_words long, buckets binary"])), "features")


def _histogram(featured: DataFrame) -> np.ndarray:
    """Features in each bucket, over the table; a task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for cell in batch.column("buckets"):
                seen += np.bincount(np.frombuffer(cell.as_buffer(), "<u2"), minlength=BUCKETS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in featured.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():  # BUCKETS rows
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket in thousandths of a nat, by counts of the corpus and of the target."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(featured: DataFrame, gain: np.ndarray) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells = [np.frombuffer(c.as_buffer(), "<u2") for c in batch.column("buckets")]
        weight = [int(gain[b].sum()) // len(b) if len(b) else 0 for b in cells]
        own = [pa.array([len(b) for b in cells], pa.int64()), pa.array(weight, pa.int64())]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), *own], ["doc_id", "n_words", "n_features", "weight"])

    return map_batches(featured, run, "doc_id long, n_words long, n_features long, weight long")


Key = tuple[int, int, int]
_NO_ID = (1 << 63) - 1


def _sorted_keys(batches: Iterator[pa.RecordBatch], low: Key | None, high: Key | None) -> np.ndarray:
    """The keys (rank of score, doc_id, row) of a task above ``low`` and below ``high``, in order."""
    parts = [np.stack([b.column(c).to_numpy() for c in ("first", "second", "third")], 1) for b in batches if b.num_rows]
    keys = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
    after = lambda k: (keys[:, 0] > k[0]) | (keys[:, 0] == k[0]) & ((keys[:, 1] > k[1]) | (keys[:, 1] == k[1]) & (keys[:, 2] > k[2]))
    if low is not None:
        keys = keys[after(low)]
    if high is not None:
        keys = keys[~after(high) & (keys != np.array(high)).any(1)]
    return keys[np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0]))]


def weighted_median(medians: list[tuple[Key, int]]) -> Key:
    """The median key that has at most half of all weight on either side."""
    total, seen = sum(n for _, n in medians), 0
    for key, n in sorted(medians):
        seen += n
        if 2 * seen >= total:
            return key
    raise ValueError("no medians")


def select_key(keys: DataFrame, k: int) -> Key:
    """The ``k``-th smallest key (first, second, third), counted from one; keys are distinct.

    Each job counts, in every partition, the remaining keys on either side of the pivot and takes the median of both
    sides, so the next pivot is known when the side is. A partition sends two rows; it holds its own keys only.
    """
    low: Key | None = None
    high: Key | None = None
    pivot: Key | None = None
    left = keys.count()
    if not 1 <= k <= left:
        raise ValueError(f"no {k}-th of {left} keys")

    def job(low: Key | None, high: Key | None, pivot: Key | None) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = _sorted_keys(batches, low, high)
            at = len(own)
            if pivot is not None:
                below = [(own[:, 0] < pivot[0]) | (own[:, 0] == pivot[0]) & ((own[:, 1] < pivot[1]) | (own[:, 1] == pivot[1]) & (own[:, 2] < pivot[2]))]
                at = int(below[0].sum())
            is_pivot = int(pivot is not None and at < len(own) and tuple(own[at].tolist()) == pivot)
            sides = [(0, own[:at]), (1, own[at + is_pivot :])]
            out = [(side, len(part), *part[(len(part) - 1) // 2].tolist()) for side, part in sides if len(part)]
            yield pa.RecordBatch.from_pylist([dict(zip(("side", "n", "first", "second", "third"), r, strict=True)) for r in out], pa.schema([("side", pa.int32()), ("n", pa.int64()), ("first", pa.int64()), ("second", pa.int64()), ("third", pa.int64())]))

        return [tuple(r) for r in keys.mapInArrow(run, "side int, n long, first long, second long, third long").collect()]  # two rows a partition

    while left > LAST:
        found = job(low, high, pivot)
        below = sum(r[1] for r in found if r[0] == 0)
        if pivot is None:
            side = 0
        elif k == below + 1:
            return pivot
        elif k <= below:
            side, high, left = 0, pivot, below
        else:
            side, low, left, k = 1, pivot, left - below - 1, k - below - 1
        pivot = weighted_median([(r[2:], r[1]) for r in found if r[0] == side])
    bounds = F.struct("first", "second", "third")
    rest = keys
    for bound, above in ((low, True), (high, False)):
        if bound is not None:
            edge = F.struct(*(F.lit(x).cast("long").alias(c) for x, c in zip(bound, ("first", "second", "third"), strict=True)))
            rest = rest.where(bounds > edge if above else bounds < edge)
    return sorted(tuple(r) for r in rest.select("first", "second", "third").collect())[k - 1]  # LAST rows


def ranked(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with ``rank``, their place (from 1) in ``order``: sorted by ranges, numbered by the sizes of the ranges before."""
    name = new_table_path(rows.sparkSession, "winners")
    rows = rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id())
    rows.write.parquet(name)
    rows = rows.sparkSession.read.schema(rows.schema).parquet(name)
    part, size = F.shiftright("place", 33), 1 << 33
    before, total = [], 0
    for p, n in sorted(tuple(r) for r in rows.groupBy(part.alias("p")).count().collect()):  # a row a partition
        before.append((p, total))
        total += n
    starts = rows.sparkSession.createDataFrame(before, "p long, before long")
    return rows.join(F.broadcast(starts), part == F.col("p")).withColumn("rank", F.col("before") + F.col("place") % size + 1).drop("place", "p", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: str = "7") -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank (null unless drawn), all long.

    A null or empty text, or one without words, has no features and weight 0. Of the N documents with ``least_words``
    words or more, floor(percent * N / 100) are drawn: highest scores first, ties to the smaller doc_id, a null doc_id
    last (its noise is that of the empty id), of repeated ids the row read first. Every row counts as a document;
    an empty target makes all gains those of unseen words; extra columns are ignored; an empty table gives an empty result.
    """
    featured = _featured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    gain = gains(_histogram(featured), _histogram(_featured(target.select("text"))))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = _weighed(featured, gain).withColumn("score", F.col("weight") + noise)
    keyed = scored.select("*", (-F.col("score")).alias("first"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("second"), F.monotonically_increasing_id().alias(ROW))
    scored = materialise(keyed.withColumn("third", F.col(ROW)).drop(ROW), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    plain = ["doc_id", "n_features", "weight", "score"]
    if not drawn:
        return scored.select(*plain, F.lit(None).cast("long").alias("rank"))
    cutoff = select_key(able.select("first", "second", "third"), drawn)
    edge = F.struct(*(F.lit(x).cast("long").alias(c) for x, c in zip(cutoff, ("first", "second", "third"), strict=True)))
    won = (F.col("n_words") >= least_words) & (F.struct("first", "second", "third") <= edge)
    winners = ranked(scored.where(won), "first", "second", "third")
    return winners.select(*plain, "rank").unionByName(scored.where(~won).select(*plain, F.lit(None).cast("long").alias("rank")))
