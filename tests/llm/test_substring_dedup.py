import hashlib
import random

import numpy as np
from pyspark.sql import Row

from helixframe.llm import substring_dedup
from helixframe.llm.fm_index import FMIndex, WaveletTree
from helixframe.llm.substring_dedup import dedup_substrings


def brute(texts, window):
    first = {}
    split = {i: (t or "").split(" ") if t else [] for i, t in texts}
    for i in sorted(split):
        for a in range(len(split[i]) - window + 1):
            first.setdefault(tuple(split[i][a : a + window]), i)
    out = {}
    for i, words in split.items():
        gone = {k for a in range(len(words) - window + 1) if first[tuple(words[a : a + window])] < i for k in range(a, a + window)}
        kept = [w for k, w in enumerate(words) if k not in gone]
        out[i] = (len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("the of a new é old one two six tea".split()) + str(rng.randrange(30))
    passage = [word() for _ in range(40)]
    texts = [None, "", "x", " ".join(passage), " ".join(["go"] * 300), " ".join(["go"] * 90 + ["stop"])]
    for _ in range(n):
        own = [word() for _ in range(rng.randrange(5, 80))]
        if rng.random() < 0.6:
            a = rng.randrange(20)
            own[len(own) // 2 : len(own) // 2] = passage[a : a + rng.randrange(10, 40)]
        texts.append(" ".join(own))
        if rng.random() < 0.2:
            texts.append(texts[-1])
    rng.shuffle(texts)
    return list(enumerate(texts))


def frame(spark, texts):
    return spark.createDataFrame([Row(doc_id=i, text=t, words="x", m=1, starts=2) for i, t in texts], "doc_id long, text string, words string, m long, starts long")


def result(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


def test_wavelet_ranks():
    s = np.random.default_rng(1).integers(0, 37, 500)
    tree = WaveletTree(s, 37)
    at = np.arange(0, 501, 7)
    for c in range(37):
        assert tree.rank(np.full(len(at), c), at).tolist() == [(s[:a] == c).sum() for a in at]


def test_matching_statistics_of_a_foreign_stream():
    rng = np.random.default_rng(2)
    text = np.concatenate([rng.integers(1, 4, 200), [0]])
    stream, window = rng.integers(1, 4, 150), 5
    index = FMIndex(text, 4, window)
    found = index.classes(stream, np.array([0, 70]), np.array([70, 150]))
    for end, places in ((70, range(70)), (150, range(70, 150))):
        for p in places:
            holds = {i for i in range(200 - window + 1) if p + window <= end and (text[i : i + window] == stream[p : p + window]).all()}
            rows = set() if found[p] < 0 else set(index.order[index.edges[found[p]] : index.edges[found[p] + 1]].tolist())
            assert rows == holds


def test_agrees_with_brute_force(spark, monkeypatch):
    texts = corpus(3)
    want = brute(texts, 12)
    assert sum(w[1] for w in want.values()) > 300
    assert result(dedup_substrings(frame(spark, texts), 12)) == want
    monkeypatch.setattr(substring_dedup, "HOT_FRAGMENTS", 2)
    monkeypatch.setattr(substring_dedup, "BROADCAST_MINIMIZERS", 0)
    assert result(dedup_substrings(frame(spark, texts), 12)) == want


def test_repeated_rows_and_rows_without_id(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long), (1, long), (None, long), (2, "a  b\t" + long)]
    got = sorted(tuple(r)[:3] for r in dedup_substrings(frame(spark, rows)).fillna(-1, ["doc_id"]).collect())
    assert got == [(-1, 60, 0), (1, 60, 0), (1, 60, 0), (2, 62, 60)]
    assert dedup_substrings(frame(spark, [])).collect() == []
