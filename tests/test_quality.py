import random
import time

import pytest
from pyspark.sql import functions as F

from helixframe.operators.quality import mott_interval, total_quality, trim, window_cut
from helixframe.plans.views import letter_qualities


def plain_window(q, window, least):
    n = len(q)
    if n < window:
        return n if n and None not in q and sum(q) >= least * n else 0
    return next((i for i in range(n - window + 1) if None not in q[i : i + window] and sum(q[i : i + window]) < least * window), n)


def plain_mott(q, least):
    total, low, best, found = 0, 0, 0, (0, len(q))
    for i, x in enumerate(q):
        if x is None:
            break
        total += x - least
        if total < 0:
            total, low = 0, i + 1
        elif total > best:
            best, found = total, (low, i + 1)
    return found


@pytest.mark.parametrize("nulls", [0, 0.1])
def test_cuts_are_the_plain_ones(spark, nulls):
    rng = random.Random(3)
    rows = [(k, [None if rng.random() < nulls else rng.randint(0, 41) for _ in range(rng.choice([0, 1, 3, 4, 5, 30, 90]))]) for k in range(300)] + [(300, None)]
    table = spark.createDataFrame(rows, "id long, qual array<int>").repartition(3)
    for window, least in ((4, 20), (4, 0), (1, 10), (7, 33)):
        made = table.select("id", "qual", window_cut(F.col("qual"), window, least).alias("keep"), mott_interval(F.col("qual"), least).alias("m"), total_quality(F.col("qual")).alias("t"))
        for r in made.collect():
            if r.qual is None:
                assert r.keep is r.m is r.t is None
                continue
            assert r.keep == plain_window(r.qual, window, least) and tuple(r.m) == plain_mott(r.qual, least)
            assert r.t == (None if None in r.qual else sum(r.qual))


def test_qualities_of_letters_and_long_reads_in_time(spark):
    table = spark.createDataFrame([("AZ",), ("",), (None,), ("M",)], "l string").coalesce(1)
    own = lambda c: 12 + 7 * (ord(c) - 64) % 29
    assert [r.q for r in table.select(letter_qualities(F.col("l")).alias("q")).collect()] == [[own("A"), own("Z")], [], None, [own("M")]]
    long = spark.range(8).select(letter_qualities(F.expr("repeat('ACGTZK', 100000)")).alias("q")).select(window_cut(F.col("q"), 4, 5).alias("k"), mott_interval(F.col("q")).alias("m"))
    began = time.perf_counter()
    assert {r.k for r in long.collect()} == {600_000} and time.perf_counter() - began < 12


def test_window_within_the_first_qualities(spark):
    """What lies beyond the adapter counts no more than if it were cut out, and no read's qualities are cut out or copied."""
    rows = [(k, q, n) for k, (q, n) in enumerate((q, n) for q in (None, [], [30], [5] * 3, [30] * 9 + [2] * 9, [30, None, 30, 30, 30, 1, 1, 1, 1], [2, 30, 30, 30, 30, 30]) for n in (None, 0, 1, 3, 4, 8, 10, 99))]
    own = spark.createDataFrame(rows, "k int, qual array<int>, n int").coalesce(1).orderBy("k")
    got = own.select(window_cut(F.col("qual"), 4, 20, F.col("n")).alias("a"), window_cut(F.slice("qual", F.lit(1), F.col("n"))).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and len({r["a"] for r in got}) > 5
    reads = spark.createDataFrame([(1, "ACGTACGT", [30] * 8)], "doc_id long, seq string, qual array<int>")
    plan = trim(reads).select("doc_id", "bases_trimmed", "discarded")._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" not in plan and "Generate" not in plan
