import random
import time
from itertools import combinations, product

import numpy as np
import pandas as pd
import pytest

from helixframe.operators import families as fam
from helixframe.operators import lamp
from helixframe.operators.primers import cross_dimers, hairpins
from helixframe.operators.scoring import Scoring


def family(rng, n=6, length=60, rate=0.08):
    base = "".join(rng.choice("ACGT") for _ in range(length))

    def change(s):
        return "".join(c if rng.random() > rate else rng.choice(["", "A", "C", c + "G"]) for c in s)

    return [change(base) for _ in range(n)]


def pairs_score(rows, s):
    total = 0
    for a, b in combinations(rows, 2):
        for x, y in zip(a, b, strict=True):
            total += 0 if x == y == "-" else s.gap if "-" in (x, y) else s.of(x, y)
    return total


@pytest.mark.parametrize("method", ["center", "tree", "profile"])
def test_rows_are_the_sequences_with_gaps(method):
    rng = random.Random(2)
    for n in (1, 2, 3, 7):
        texts = [*family(rng, n), ""][: n + (n == 7)]
        rows = fam.METHODS[method](texts)
        assert len({len(r) for r in rows}) == 1 and [r.replace("-", "") for r in rows] == texts
    assert fam.METHODS[method](["ACGT"]) == ["ACGT"] and fam.average_identity(["ACGT"]) == 100


def test_profiles_and_refinement_do_not_lose_to_the_tree():
    rng, s = random.Random(4), Scoring()
    better = []
    for _ in range(8):
        texts = family(rng, 7, 80, 0.15)
        tree, profile, once = fam.tree_alignment(texts), fam.tree_alignment(texts, profiles=True), fam.tree_alignment(texts, profiles=True, passes=0)
        for rows in (tree, profile):
            assert fam.sum_of_pairs(rows, s) == pairs_score(rows, s)
        assert fam.sum_of_pairs(profile, s) >= fam.sum_of_pairs(once, s)
        better.append(fam.sum_of_pairs(profile, s) - fam.sum_of_pairs(tree, s))
    assert np.mean(better) > 0


def test_two_groups_merge_at_the_best_sum_of_pairs():
    rng, s = random.Random(5), Scoring()

    def best(a, b):
        """Over all ways to interleave the columns of short groups."""
        n, m = len(a[0]), len(b[0])
        found = []

        def walk(i, j, rows):
            if (i, j) == (n, m):
                found.append(pairs_score(["".join(r) for r in rows], s))
                return
            for di, dj in ((1, 1), (1, 0), (0, 1)):
                if i + di <= n and j + dj <= m:
                    walk(i + di, j + dj, [r + [x[i] if di else "-"] for r, x in zip(rows, a, strict=False)] + [r + [x[j] if dj else "-"] for r, x in zip(rows[len(a) :], b, strict=True)])

        walk(0, 0, [[] for _ in (*a, *b)])
        return max(found)

    for _ in range(12):
        a = ["".join(rng.choice("ACG-") for _ in range(4)) for _ in range(2)]
        b = ["".join(rng.choice("ACG-") for _ in range(3)) for _ in range(2)]
        x, y = fam.merge_rows(a, b, s)
        assert pairs_score(x + y, s) == best(a, b)


def test_overlaps_and_layout():
    rng = random.Random(1)
    for _ in range(30):
        a, b = ("".join(rng.choice("ACGT") for _ in range(rng.randint(1, 30))) for _ in range(2))
        assert fam.overlap_matches(a, b) == [sum(x == y for x, y in zip(a[len(a) - n :], b[:n], strict=True)) for n in range(min(len(a), len(b)) + 1)]
    d = np.array([[0, 2, 6, 6], [2, 0, 6, 6], [6, 6, 0, 4], [6, 6, 4, 0]], float)
    assert fam.layout(fam.build_tree(d), 4) == {0: (3.0, 0.0), 1: (3.0, 1.0), 2: (3.0, 2.0), 3: (3.0, 3.0), 4: (2.0, 0.5), 5: (1.0, 2.5), 6: (0.0, 1.5)}


def test_families_above_the_bound_are_an_error(spark, monkeypatch):
    monkeypatch.setattr("helixframe.operators.families.MOST_ROWS", 2)
    rows = spark.createDataFrame([(1, i, "ACGT") for i in range(2)], "family_id long, idx long, seq string")
    assert fam.alignments(rows).count() == 2


def test_consensus_of_wells(spark):
    passes = [("m/1/0_8", "ACGTACGT"), ("m/1/9_16", "ACGACGT"), ("m/1/17_25", "ACGTACGTT"), ("m/2/ccs", "GGGG"), ("odd", "TT"), (None, "C"), ("m/3/0_1", None)]
    got = {r["well"]: (r["passes"], r["kind"], r["seq"]) for r in fam.circular_consensus(spark.createDataFrame(passes, "name string, seq string")).collect()}
    assert got == {"m/1": (3, "consensus", "ACGTACGT"), "m/2": (1, "single_pass", "GGGG"), "odd": (1, "single_pass", "TT"), None: (1, "single_pass", "C"), "m/3": (1, "single_pass", "")}


def plain_side(template, first, scan, reverse):
    best = None
    for start in range(first, min(first + scan, len(template))):
        for outer, gap1, inner, gap2, tail in product(lamp.LENGTHS, lamp.GAPS, lamp.LENGTHS, lamp.GAPS, lamp.LENGTHS):
            places = [start, start + outer + gap1, start + outer + gap1 + inner + gap2]
            own = [lamp.pieces(template, range(p, p + 1), n, r)[0][0] for p, n, r in zip(places, (outer, inner, tail), reverse, strict=True)]
            if all(own):
                tm, risk = [lamp._tm(x) for x in own], hairpins(pd.Series(own)).sum() / 3
                score = min(max(100 - (max(tm) - min(tm)) * 3 - risk * 25 - (gap1 + gap2) * 0.3, 0), 100)
                if best is None or score > best[0] + 1e-9:
                    best = (score, own)
    return best


def test_lamp_sides_against_plain_loops_and_invariants():
    rng = random.Random(7)
    template = "".join(rng.choice("ACGT") for _ in range(400))
    for reverse in ((False, False, True), (False, True, True)):
        found, want = lamp.best_side(template, 10, 3, reverse), plain_side(template, 10, 3, reverse)
        assert abs(found["score"] - want[0]) < 1e-9 and [p[0] for p in found["pieces"]] == want[1]
    sets = lamp.design(template)
    assert 0 < len(sets) <= 3 and [s[-1] for s in sets] == sorted((s[-1] for s in sets), reverse=True)
    for core, f3, f2, f1c, b1, b2, b3, fip, bip, _, _, f3_start, b3_end, score in sets:
        places = [template.index(x) for x in (f3, f2, lamp.turned(f1c), b1, lamp.turned(b2), lamp.turned(b3))]
        assert places == sorted(places) and places[0] == f3_start and template.index(lamp.turned(b3)) + len(b3) == b3_end
        assert fip == f1c + f2 and bip == b1 + b2 and 0 <= score <= 100 and core == places[3] - places[2] - len(f1c)
    assert lamp.design("ACGT" * 30) == [] and lamp.design("A" * 400) == [] and lamp.design("") == []


def test_lamp_sets_of_many_templates_at_once():
    """Sets of a batch are those of each template alone, by its own sides; a thousand letters take milliseconds."""
    rng = random.Random(9)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (0, 149, 150, 170, 260, 450, 900) for letters in ("ACGT", "AACGT", "ACGTN")]
    made = lamp.designs(texts)
    assert made == [lamp.design(t) for t in texts] and sum(map(len, made)) > 10
    for t, sets in zip(texts, made, strict=True):
        for core, f3, f2, f1c, *rest, f3_start, b3_end, score in sets:
            front = lamp.best_side(t, 0, min(max(int(len(t) * 0.5 + 0.5), 30), 220), lamp.FRONT)
            assert [p[0] for p in front["pieces"]] == [f3, f2, f1c] and front["pieces"][0][1] == f3_start
    pieces = ["".join(rng.choice("ACGT") for _ in range(rng.randint(1, 44))) for _ in range(80)]
    assert lamp.dimers(pieces, pieces[::-1]).tolist() == cross_dimers(pd.Series(pieces), pd.Series(pieces[::-1])).tolist()
    began = time.perf_counter()
    lamp.designs(["".join(rng.choice("ACGT") for _ in range(1000)) for _ in range(96)])
    assert time.perf_counter() - began < 4


def test_lamp_sets_of_whole_templates(spark):
    """Where a set can only lie behind the first letters it is found there; sides are the best of either half."""
    rng = random.Random(21)
    texts = ["A" * 700 + "".join(rng.choice("ACGT") for _ in range(900)), "".join(rng.choice("ACGT") for _ in range(1500)), "ACGTTGCAAC" * 20]
    made = lamp.designs(texts, most=None)
    assert lamp.designs(texts)[0] == [] and made[0] and made == [lamp.design(t, most=None) for t in texts]
    for t, sets in zip(texts, made, strict=True):
        for core, f3, f2, f1c, *rest, f3_start, b3_end, score in sets:
            front = lamp.best_side(t, 0, int(len(t) * 0.5 + 0.5), lamp.FRONT)
            assert [p[0] for p in front["pieces"]] == [f3, f2, f1c] and front["pieces"][0][1] == f3_start
    got = lamp.lamp_sets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, seq string")).collect()
    assert sorted((r["doc_id"], r["rank"], r["f3_start"], r["b3_end"]) for r in got) == [(k, n, *s[-3:-1]) for k, sets in enumerate(made) for n, s in enumerate(sets, 1)]


def test_cross_dimers_against_plain_loops():
    rng = random.Random(3)
    a, b = (["".join(rng.choice("ACGT") for _ in range(rng.randint(1, 12))) for _ in range(60)] for _ in range(2))

    def plain(x, y):
        r = lamp.turned(y)
        return max(sum(0 <= i + s < len(r) and x[i] == r[i + s] for i in range(len(x))) for s in range(1 - len(x), len(x))) / len(x)

    assert cross_dimers(pd.Series(a), pd.Series(b)).tolist() == [plain(x, y) for x, y in zip(a, b, strict=True)]


def test_wells_are_aligned_together(monkeypatch):
    calls = []
    whole = fam.align_batch
    monkeypatch.setattr(fam, "align_batch", lambda a, b, *more: calls.append(len(a)) or whole(a, b, *more))
    wells = [["ACGTACGT", "ACGACGT", "ACGTACGTT"], ["GGGG"], ["", ""], ["ACCA", "ACA"]] * 20
    assert fam.well_consensus(wells) == [(3, "consensus", "ACGTACGT"), (1, "single_pass", "GGGG"), (2, "consensus", ""), (2, "consensus", "ACCA")] * 20
    assert calls == [80]


def test_columns_of_gaps_go_at_once():
    assert fam.without_gap_columns(["A--Cé", "A-G-é"]) == ["A-Cé", "AG-é"] and fam.without_gap_columns(["--", "--"]) == ["", ""]
    rows = ["ACGT-" * 200_000, "A-GT-" * 200_000]
    began = time.perf_counter()
    assert len(fam.without_gap_columns(rows)[0]) == 800_000 and time.perf_counter() - began < 0.2


def test_overlaps_bound_by_classes_are_those_of_all_letters(monkeypatch):
    """Transforms: one a text and one a pair, where all letters' took twelve; texts of one class fall back to all letters."""
    rng = np.random.default_rng(8)
    pairs = []
    for letters in ("ACGT", "AC", "A", "ACGT\u00e9-"):
        for _ in range(12):
            a, b = ("".join(rng.choice(list(letters), rng.integers(20, 260))) for _ in range(2))
            pairs += [(a, b), (a + b[:40], b), (a, a[len(a) // 3 :] + b)]
    for identity in (60.0, 90.0, 100.0):
        for a, b in pairs:
            matches = [sum(x == y for x, y in zip(a[len(a) - n :], b[:n], strict=True)) for n in range(min(len(a), len(b)) + 1)]
            fits = [n for n in range(20, len(matches)) if 100.0 * matches[n] / n >= identity]
            assert fam._Overlaps(20, identity).longest(a, b) == ((fits[-1], matches[fits[-1]]) if fits else (0, 0))
    made = []
    monkeypatch.setattr(fam, "overlap_matches", lambda a, b: made.append(1))
    genome = "".join(rng.choice(list("ACGT"), 600))
    assert [c for c, _ in fam.assemble([genome[:300], genome[200:500], genome[400:]])] == [genome] and not made


def test_groups_joined_by_their_first_rows_look_at_no_other_letters(monkeypatch):
    """One table of scores, of the first rows' letters; all rows get the gaps, letters beyond 16 bits too."""
    asked, own = [], Scoring.table
    monkeypatch.setattr(Scoring, "table", lambda self, letters: asked.append(letters) or own(self, letters))
    a, b = fam.merge_rows(["ACGTAC", "AC\U0001f600TNN"], ["ACTAC", "XYZ--"], Scoring(), whole=False)
    assert asked == [["A", "C", "G", "T"]]
    assert (a, b) == (["ACGTAC", "AC\U0001f600TNN"], ["AC-TAC", "XY-Z--"])
