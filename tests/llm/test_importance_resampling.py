"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import helixframe.llm.importance_resampling as ir
from helixframe.llm.importance_resampling import features, gains, ranked, resample, select_key, weighted_median

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text):
    words = WORDS.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]


def plain(docs, items):
    own = [plain_features(t) for _, t in docs]
    s, t = Counter(b for _, f in own for b in f), Counter(b for x in items for b in plain_features(x)[1])
    big_s, big_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    rows = []
    for (i, _), (n, f) in zip(docs, own, strict=True):
        w = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: 25 * len(able) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def corpus(n):
    rng = np.random.default_rng(n)
    words = [f"w{k}" for k in range(300)] + ["Über", "naïve", "日本語", "A1", "it's", "X Y"]
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(0, 60))))) for i in range(n)]
    items = [" ".join(rng.choice(words[:40], 30)) for _ in range(20)]
    return docs, items


@pytest.mark.parametrize("text", ["", None, "a", "Don't STOP-me 3 times", "É é\tÄ\x1cb\x7fc", "日本 語 語", "x" * 100_000, "ab cd " * 50_000])
def test_features_are_the_defined_ones(text):
    n, got = features(None if text is None else text.encode())
    assert (n, sorted(got.tolist())) == (plain_features(text)[0], sorted(plain_features(text)[1]))


def test_resample_equals_plain(spark):
    docs, items = corpus(500)
    docs += [(900, None), (901, ""), (902, "!?"), (None, "one two three " * 20), (903, "w1 w2 " * 30_000)]
    got = resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == plain(docs, items)


def test_selection_is_used_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(ir, "LAST", 3)
    docs, items = corpus(400)
    got = resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == plain(docs, items)


def test_odd_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert resample(docs, items).count() == 0
    text = " ".join(f"v{k}" for k in range(25))
    same = spark.createDataFrame([(5, text, "a", 1, 2)] * 8, "doc_id long, text string, _row string, first long, rank long")
    got = resample(same, items).orderBy("rank").collect()
    assert sorted((r.rank or 0) for r in got) == [0] * 6 + [1, 2] and {tuple(r)[:2] for r in got} == {(5, 49)} and len(got[0]) == 5


@pytest.mark.parametrize("k", [1, 2, 137, 499, 500])
def test_select_key_with_ties_and_empty_partitions(spark, monkeypatch, k):
    monkeypatch.setattr(ir, "LAST", 0)
    rng = np.random.default_rng(k)
    rows = [(int(a), int(b), c) for c, (a, b) in enumerate(zip(rng.integers(0, 6, 500), rng.integers(0, 4, 500), strict=True))]
    keys = spark.createDataFrame(rows, "first long, second long, third long").repartition(9, F.col("first"))
    assert select_key(keys, k) == sorted(rows)[k - 1]


def test_weighted_median_leaves_half_on_either_side():
    rng = np.random.default_rng(8)
    for _ in range(200):
        m = [((int(x), 0, k), int(n)) for k, (x, n) in enumerate(zip(rng.integers(0, 9, 7), rng.integers(1, 50, 7), strict=True))]
        key, total = weighted_median(m), sum(n for _, n in m)
        assert 2 * sum(n for q, n in m if q < key) <= total and 2 * sum(n for q, n in m if q > key) <= total


def test_ranked_numbers_rows_over_partitions(spark):
    rows = ranked(spark.range(1000).repartition(6), "id").collect()
    assert sorted((r["id"], r["rank"]) for r in rows) == [(i, i + 1) for i in range(1000)]


def test_gains_of_empty_counts():
    assert set(gains(np.zeros(10000, np.int64), np.zeros(10000, np.int64)).tolist()) == {0}
