"""Read quality: reports, grades and trimming, row by row in Catalyst expressions; what looks at each quality of a read in
turn is worked in Arrow arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.letters import ranges
from helixframe.functions.sequence import at_content, count_of, gc_content

ADAPTER = "AGATCGGAAGAGC"
#: Rows of a barcode sheet at most: it is sent to all tasks.
SAMPLES = 100_000


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _lists(qual: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(values of all rows with zero for null, first place of each row and of none, size of each row, values that are null)."""
    sizes = qual.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = qual.flatten()
    return flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]), sizes, flat.is_null().to_numpy(zero_copy_only=False)


def _totals(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values, dtype=np.int64)])


def total_quality(qual: Column) -> Column:
    """Sum of each array; null where it or one of its values is."""

    @F.arrow_udf("long")
    def run(own: pa.Array) -> pa.Array:
        values, places, _, missing = _lists(own)
        sums, gone = _totals(values), _totals(missing)
        return pa.array(sums[places[1:]] - sums[places[:-1]], mask=own.is_null().to_numpy(zero_copy_only=False) | (gone[places[1:]] > gone[places[:-1]]))

    return run(qual)


def quality_report(reads: DataFrame) -> DataFrame:
    """Per read: length, GC, AT and N percent, mean, least and best quality, Q20 and Q30 percent, grade (A to D).

    Without qualities the quality figures are null and the grade goes by N and length.
    """
    n, has = F.length("seq"), F.col("qual").isNotNull() & (F.size("qual") > 0)
    n_percent = F.when(n > 0, count_of(F.col("seq"), "N") * 100.0 / n).otherwise(0.0)
    share = lambda q: F.when(has, F.size(F.filter("qual", lambda x: x >= q)) * 100.0 / F.size("qual"))
    measured = reads.select(
        "*", n.alias("length"), gc_content(F.col("seq")).alias("gc"), at_content(F.col("seq")).alias("at"), n_percent.alias("n_percent"),
        F.when(has, total_quality(F.col("qual")) / F.size("qual")).alias("mean_q"), F.array_min("qual").alias("min_q"), F.array_max("qual").alias("max_q"), share(20).alias("q20"), share(30).alias("q30"),
    )
    q, npc = F.col("mean_q"), F.col("n_percent")
    with_q = F.when((q >= 30) & (npc < 1), "A").when((q >= 20) & (npc < 5), "B").when(q >= 15, "C").otherwise("D")
    without = F.when((npc < 0.5) & (n > 50), "A").when(npc < 2, "B").when(npc < 5, "C").otherwise("D")
    return measured.withColumn("grade", F.when(q.isNotNull(), with_q).otherwise(without))


def quality_bins(reads: DataFrame, bins: int = 20) -> DataFrame:
    """(doc_id, bin, mean_q): mean quality along each read in at most ``bins`` stretches of one width."""
    width = F.ceil(F.size("qual") / F.lit(bins)).cast("int")
    starts = F.sequence(F.lit(0), F.floor((F.size("qual") - 1) / width).cast("int"))
    means = F.transform(starts, lambda b: _sum(F.slice("qual", b * width + 1, width)) / F.size(F.slice("qual", b * width + 1, width)))
    return reads.where(F.size("qual") > 0).select("doc_id", F.posexplode(means).alias("bin", "mean_q"))


def window_cut(qual: Column, window: int = 4, least: int = 20, within: Column | None = None) -> Column:
    """Bases kept: up to the first window whose mean is below ``least``; a shorter read stays whole or goes.

    Only the first ``within`` qualities count (null: a null result); they are not cut out first.
    """

    @F.arrow_udf("int")
    def run(own: pa.Array, most: pa.Array) -> pa.Array:
        sizes = own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        limits = most.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        keep = [_window_cut(own.slice(at, end - at), limits[at:end], window, least) for at, end in ranges(sizes)]
        null = own.is_null().to_numpy(zero_copy_only=False) | most.is_null().to_numpy(zero_copy_only=False)
        return pa.array(np.concatenate([np.zeros(0, np.int32), *keep]).astype(np.int32), mask=null)

    return run(qual, (F.size(qual) if within is None else within).cast("int"))


def _window_cut(qual: pa.Array, within: np.ndarray, window: int, least: int) -> np.ndarray:
    values, places, sizes, missing = _lists(qual)
    sizes, starts = np.minimum(sizes, within), places[:-1]
    sums, gone = _totals(values), _totals(missing)
    count = max(0, len(values) - window + 1)
    low = (sums[window:] - sums[: len(sums) - window])[:count] < least * window
    low &= (gone[window:] == gone[: len(gone) - window])[:count]  # what holds a null is not below
    bad = np.append(np.flatnonzero(low), len(values) + window)
    first = bad[np.searchsorted(bad, starts)] - starts
    keep = np.where(first <= sizes - window, first, sizes)
    whole = (sizes > 0) & (sums[starts + sizes] - sums[starts] >= least * sizes) & (gone[starts + sizes] == gone[starts])
    return np.where(sizes < window, np.where(whole, sizes, 0), keep)


def mott_interval(qual: Column, least: int = 20) -> Column:
    """(start, end) of the stretch with the greatest sum of quality - ``least``; the whole read where none is above zero."""

    @F.arrow_udf("start int, end int")
    def run(own: pa.Array) -> pa.Array:
        values, places, sizes, missing = _lists(own)
        found = np.zeros((2, len(own)), np.int32)
        found[1] = sizes
        for k in np.flatnonzero(sizes).tolist():
            at = slice(places[k], places[k + 1])
            stop = int(missing[at].argmax()) if missing[at].any() else None  # nothing is better from a null on
            sums = _totals(values[at][:stop] - least)
            if len(sums) > 1:
                gains = sums[1:] - np.minimum.accumulate(sums[:-1])
                end = int(gains.argmax())
                if gains[end] > 0:
                    found[:, k] = sums[: end + 1].argmin(), end + 1
        null = own.is_null()
        return pa.StructArray.from_arrays([pa.array(x) for x in found], ["start", "end"], mask=null)

    return run(qual)


def adapter_cut(seq: Column, adapter: str = ADAPTER, probe: int = 12) -> Column:
    """Bases before the first ``probe`` bases of the adapter, all where it is absent."""
    at = F.instr(seq, adapter[:probe])
    return F.when(at > 0, at - 1).otherwise(F.length(seq))


def trim(reads: DataFrame, adapter: str = ADAPTER, probe: int = 12, window: int = 4, least: int = 20, min_length: int = 20, max_length: int | None = None, head: int = 0, tail: int = 0) -> DataFrame:
    """Hard trim, adapter, quality window, length flag: columns seq, qual, length_before, bases_trimmed, discarded, reason.

    All reads stay; those out of bounds are flagged.
    """
    long, seq, qual = F.lit(False), F.col("seq"), F.col("qual")
    if head + tail:
        long = F.length("seq") > head + tail
        seq = F.when(long, F.expr(f"substring(seq, {head + 1}, length(seq) - {head + tail})")).otherwise(seq)
        qual = F.when(long, F.slice("qual", F.lit(head + 1), F.greatest(F.size("qual") - (head + tail), F.lit(0)))).otherwise(qual)
    hard = reads.select(*(c for c in reads.columns if c not in ("seq", "qual")), F.length("seq").alias("length_before"), long.alias("hard"), seq.alias("seq"), qual.alias("qual"))
    cut = hard.withColumn("a", adapter_cut(F.col("seq"), adapter, probe))
    cut = cut.withColumn("keep", F.when(F.col("qual").isNull(), F.col("a")).otherwise(window_cut(F.col("qual"), window, least, F.col("a"))))
    n = F.col("keep")
    rules = [(F.col("hard"), "hard"), (F.col("a") < F.length("seq"), "adapter"), (n < F.col("a"), "low_quality"), (n < min_length, "too_short")]
    rules += [(n > max_length, "too_long")] if max_length else []
    reasons = F.concat_ws("+", *(F.when(when, name) for when, name in rules))
    discarded = (n < min_length) | ((n > max_length) if max_length else F.lit(False))
    rest = [c for c in hard.columns if c not in ("seq", "qual", "hard", "length_before")]
    return cut.select(*rest, F.expr("substring(seq, 1, keep)").alias("seq"), F.slice("qual", F.lit(1), n).alias("qual"), "length_before", (F.col("length_before") - n).alias("bases_trimmed"), discarded.alias("discarded"), reasons.alias("reason"))


def demultiplex(reads: DataFrame, barcodes: DataFrame, mismatches: int = 1, keep_unassigned: bool = True) -> DataFrame:
    """Reads by the first barcode (idx, sample, barcode) within ``mismatches`` of their start, which is cut off.

    The sheet is folded into one array for all reads, so a read is neither shuffled nor multiplied. It has a row for each
    sample, SAMPLES at most: a larger one is an error. Null reads are unassigned; ties go to the lowest idx.
    """
    if (samples := barcodes.count()) > SAMPLES:
        raise ValueError(f"a barcode sheet has at most {SAMPLES} rows, this one {samples}")
    sheet = barcodes.agg(F.array_sort(F.collect_list(F.struct("idx", "sample", "barcode"))).alias("sheet"))

    def matches(b: Column) -> Column:
        pairs = F.zip_with(F.split(b["barcode"], ""), F.split(F.substring(F.col("seq"), F.lit(1), F.length(b["barcode"])), ""), lambda x, y: x != y)
        return (F.length("seq") >= F.length(b["barcode"])) & (F.size(F.filter(pairs, lambda d: d)) <= mismatches)

    found = reads.crossJoin(F.broadcast(sheet)).withColumn("hit", F.explode_outer(F.array(F.get(F.filter("sheet", matches), F.lit(0)))))  # one row on the right; one hit, looked up once
    cut = F.coalesce(F.length("hit.barcode"), F.lit(0))
    columns = [F.col(c) for c in reads.columns if c not in ("seq", "qual")]
    out = found.select(*columns, F.coalesce("hit.sample", F.lit("")).alias("sample"), F.substring(F.col("seq"), cut + 1, F.length("seq")).alias("seq"), *([F.slice("qual", cut + 1, F.size("qual")).alias("qual")] if "qual" in reads.columns else []))
    return out if keep_unassigned else out.where("sample <> ''")
