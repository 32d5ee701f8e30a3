import random
import re
import time

import numpy as np
import pandas as pd
import pytest

from helixframe.operators import primers
from helixframe.operators.primers import Windows, best_of_strands, best_primers, candidates, cross_dimers, hairpins, primer_pairs, self_dimers


def plain_hairpin(p):
    n, turned, best = len(p), p[::-1].translate(str.maketrans("ACGT", "TGCA")), 0
    for i in range(n - 3):
        for j in range(n):
            if abs(i - j) > 3:
                k = 0
                while i + k < n and j + k < n and p[i + k] == turned[j + k]:
                    k += 1
                best = max(best, k)
    return best / n


def plain_dimer(p):
    n, turned = len(p), p[::-1].translate(str.maketrans("ACGT", "TGCA"))
    return max(sum(0 <= i + s < n and p[i] == turned[i + s] for i in range(n)) for s in range(1 - n, n)) / n


def plain_primers(t, shortest, longest, top):
    found = []
    for n in range(shortest, longest + 1):
        for i in range(len(t) - n + 1):
            p = t[i : i + n]
            strong = p.count("G") + p.count("C")
            gc = strong * 100.0 / n
            tm = 81.5 + 0.41 * gc - 675.0 / n if n >= 14 else 2.0 * (p.count("A") + p.count("T")) + 4.0 * strong
            if 30 <= gc <= 70 and not re.search("A{5,}|T{5,}|G{5,}|C{5,}", p):
                score = 100 - 1.5 * max(40 - gc, gc - 60, 0) - 1.2 * max(55 - tm, tm - 65, 0) - 30 * plain_hairpin(p) - 20 * plain_dimer(p)
                score = min(max(score, 0.0), 100.0)
                if score >= 40:
                    found.append((-score, i, n, gc, tm))
    return [(i, t[i : i + n], gc, tm, -s) for s, i, n, gc, tm in sorted(found)[:top]]


@pytest.mark.parametrize("letters", ["ACGT", "AC", "AT", "ACGTN", "GC"])
@pytest.mark.parametrize("n", [4, 5, 7, 8, 9, 11, 18, 24])
def test_windows_are_the_plain_risks(letters, n):
    rng = random.Random(n)
    t = "".join(rng.choice(letters) for _ in range(120)) + "ACGTACGT" + "A" * 9
    w, own = Windows(np.frombuffer(t.encode(), np.uint8), n), [t[i : i + n] for i in range(len(t) - n + 1)]
    assert (w.hairpins(n) / n).tolist() == [plain_hairpin(p) for p in own] == hairpins(pd.Series(own)).tolist()
    assert (w.dimers(n) / n).tolist() == [plain_dimer(p) for p in own] == self_dimers(pd.Series(own)).tolist()


@pytest.mark.parametrize("bounds", [(18, 24, 60), (8, 12, 20), (3, 6, 5)])
def test_primers_are_the_plain_ones(bounds):
    rng = random.Random(5)
    for length in (0, 2, 17, 18, 60, 140):
        for letters in ("ACGT", "AACGTN", "ACGTé"):
            t = "".join(rng.choice(letters) for _ in range(length)) + rng.choice(["", "GGGGGG", "ACGT" * 8])
            found, want = best_primers(t, *bounds), plain_primers(t, *bounds)
            assert [f[:2] for f in found] == [w[:2] for w in want] or len(t) == 0
            assert np.allclose([f[2:] for f in found], [w[2:] for w in want], atol=1e-9) or not want


def test_long_templates_in_time():
    rng = random.Random(1)
    for t in ("".join(rng.choice("ACGT") for _ in range(200_000)), "A" * 200_000, "ACGT" * 50_000):
        began = time.perf_counter()
        best_primers(t, 18, 24, 60)
        assert time.perf_counter() - began < 5


def test_candidates_and_pairs_of_tables(spark):
    rng = random.Random(8)
    rows = [(1, "".join(rng.choice("ACGT") for _ in range(420))), (2, None), (3, ""), (4, "ACGT" * 4), (None, "".join(rng.choice("ACGT") for _ in range(60)))]
    table = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, seq string, primer string, rank int")
    turned = rows[0][1][::-1].translate(str.maketrans("ACGT", "TGCA"))
    got = candidates(table).collect()
    for strand, text in (("+", rows[0][1]), ("-", turned)):
        own = sorted((r for r in got if r.doc_id == 1 and r.strand == strand), key=lambda r: r.rank)
        assert [(r.start, r.primer) for r in own] == [w[:2] for w in plain_primers(text, 18, 24, 60)] and len(own) == 60
    assert {r.doc_id for r in got} == {1, None}
    f, b = ([r for r in got if r.doc_id == 1 and r.strand == s] for s in "+-")
    want = []
    for x in f:
        for y in b:
            product, gap = 420 - y.start - x.start, abs(x.tm - y.tm)
            if 100 <= product <= 1000 and gap <= 5:
                r = y.primer[::-1].translate(str.maketrans("ACGT", "TGCA"))
                cross = max(sum(0 <= i + s < len(r) and x.primer[i] == r[i + s] for i in range(len(x.primer))) for s in range(1 - len(x.primer), len(x.primer))) / len(x.primer)
                want.append((round(min(max((x.score + y.score) / 2 - 2 * gap - 15 * min(cross, 1), 0), 100), 9), x.start, 420 - y.start, x.primer, y.primer))
    want = sorted(want, key=lambda w: (-w[0], *w[1:]))[:10]
    pairs = primer_pairs(table).orderBy("rank").collect()
    assert [(round(p.pair_score, 9), p.f_start, p.r_end, p.forward, p.reverse) for p in pairs if p.doc_id == 1] == want


def test_pairs_in_time_of_the_input(spark):
    """A template's pairs are scored where its row is: no join, no shuffle, rows of one or no id apart, ties as ordered."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("ACGT") for _ in range(500)), "".join(rng.choice("ACGT") for _ in range(500)), "ACGTTGCAAC" * 40, "GC" * 200, "ACGTé" * 60]
    table = spark.createDataFrame([(k, t) for k, t in zip((7, 7, None, 8, 9), texts, strict=True)], "doc_id long, seq string")
    made = primer_pairs(table)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = made.collect()
    assert len([r for r in got if r.doc_id == 7]) == 20 and len([r for r in got if r.doc_id is None]) == 10
    for both in zip(texts, best_of_strands(texts, 18, 24, 60), strict=True):
        t, ((starts, lengths, _, tm, score), (r_starts, r_lengths, _, r_tm, r_score)) = both
        want = []
        for x in range(len(starts)):
            for y in range(len(r_starts)):
                end, gap = len(t) - r_starts[y], abs(tm[x] - r_tm[y])
                if 100 <= end - starts[x] <= 1000 and gap <= 5:
                    f, r = t[starts[x] : starts[x] + lengths[x]], t[end - r_lengths[y] : end][::-1].translate(str.maketrans("ACGT", "TGCA"))
                    want.append((-round((score[x] + r_score[y]) / 2 - 2 * gap - 15 * cross_dimers(pd.Series([f]), pd.Series([r]))[0], 9), starts[x], end, f, r))
        own = [r for r in got if r.forward in t and r.f_start == t.find(r.forward, r.f_start)]
        assert sorted(want)[:10] == [w for w in sorted(want) if any((-round(r.pair_score, 9), r.f_start, r.r_end, r.forward, r.reverse) == w for r in own)][:10]


def test_parts_of_a_batch_are_the_templates_alone(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 3, 17, 18, 30, 90]))) for _ in range(40)]
    monkeypatch.setattr(primers, "PART_LETTERS", 150)
    for t, both in zip(texts, best_of_strands(texts, 18, 24, 9), strict=True):
        for text, (starts, lengths, *_) in zip((t, t[::-1].translate(str.maketrans("ACGT", "TGCA"))), both, strict=True):
            assert [(s, text[s : s + n]) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)] == [w[:2] for w in plain_primers(text, 18, 24, 9)]
