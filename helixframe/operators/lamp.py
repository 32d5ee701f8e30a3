"""Loop-mediated amplification primers: two sides of three neighbouring pieces around a core.

Sides are searched at once for all starts, lengths and gaps, and for many templates: pieces are scored in arrays, each
distinct piece once, and only of the letters that a set can lie in.
"""

from __future__ import annotations

import re
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.primers import ARROW, REPEAT, TURN, Windows, crossed, hairpins, marks

_TURN = str.maketrans("ACGT", "TGCA")
_REPEAT = re.compile("A{5,}|T{5,}|G{5,}|C{5,}")
#: Shortest template, piece lengths, gaps within a side, bases between the sides, starts searched on a side (half the
#: template's, from the first of these numbers to the second).
LEAST, LENGTHS, GAPS, CORES, STARTS = 150, (18, 20, 22), (0, 1, 2), (40, 60, 80), (30, 220)
#: Letters of a side at most, and templates and letters that are worked together.
SIDE = 3 * LENGTHS[-1] + 2 * GAPS[-1]
PART, PART_LETTERS = 24, 50_000
#: Outer piece, gap, inner piece, gap and tail of a side.
CHOICES = list(product(LENGTHS, GAPS, LENGTHS, GAPS, LENGTHS))
FRONT, BACK = (False, False, True), (False, True, True)
SCHEMA = "doc_id long, rank int, core int, f3 string, f2 string, f1c string, b1 string, b2 string, b3 string, fip string, bip string, lf string, lb string, f3_start int, b3_end int, score double"


def turned(s: str) -> str:
    return s[::-1].translate(_TURN)


def _tm(s: str) -> float:
    gc = s.count("G") + s.count("C")
    return 81.5 + 0.41 * (gc * 100.0 / len(s)) - 675.0 / len(s)


def pieces(template: str, starts: range, length: int, reverse: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(oligo, melting point, hairpin risk) of the piece at each start; no oligo and NaN where it is not acceptable."""
    out = []
    for start in starts:
        region = template[start : start + length]
        share = (region.count("G") + region.count("C")) * 100.0 / length
        good = len(region) == length and 30 <= share <= 70 and not _REPEAT.search(region)
        out.append((turned(region) if reverse else region) if good else "")
    risk = hairpins(pd.Series(out)).to_numpy()
    tm = np.array([_tm(x) if x else np.nan for x in out])
    return out, tm, np.where(np.isnan(tm), np.nan, risk)


class Sides:
    """Melting points and hairpin risks of the pieces at all places of some templates, a row for each, and their best
    sides. A piece that is not acceptable has an endless risk."""

    def __init__(self, templates: list[str]) -> None:
        own = [np.frombuffer(t.encode("ascii", "replace"), np.uint8) for t in templates]
        self.sizes = np.array([len(x) for x in own], np.int64)
        shape = (len(own), int(self.sizes.max(initial=0)) + SIDE)
        letters = np.zeros(shape, np.uint8)
        for row, x in zip(letters, own, strict=True):
            row[: len(x)] = x
        left = (self.sizes[:, None] - np.arange(shape[1])).ravel()
        letters = letters.ravel()
        size = len(letters)
        forward, backward = Windows(letters, LENGTHS[-1], LENGTHS[0]), Windows(TURN[letters][::-1].copy(), LENGTHS[-1], LENGTHS[0])
        counts = lambda x: np.concatenate([[0], np.cumsum(x)])
        strong = counts((letters == ord("G")) | (letters == ord("C")))
        run = np.isin(letters, np.frombuffer(b"ACGT", np.uint8))[: size - REPEAT + 1]
        for x in range(1, REPEAT):
            run = run & (letters[x : x + len(run)] == letters[: len(run)])
        runs = counts(run)
        self.tm, self.risk = {}, {}
        for n in LENGTHS:
            count = size - n + 1
            share = (strong[n:] - strong[:-n]) * 100.0 / n
            bad = (left[:count] < n) | (share < 30) | (share > 70) | (runs[n - REPEAT + 1 :][:count] > runs[:count])
            self.tm[n] = self._table(shape, np.where(bad, 0.0, 81.5 + 0.41 * share - 675.0 / n), 0.0)
            for reverse, found in ((False, forward.hairpins(n)), (True, backward.hairpins(n)[::-1])):
                self.risk[n, reverse] = self._table(shape, np.where(bad, np.inf, found / n), np.inf)

    @staticmethod
    def _table(shape: tuple[int, int], values: np.ndarray, rest: float) -> np.ndarray:
        return np.concatenate([values, np.full(shape[0] * shape[1] - len(values), rest)]).reshape(shape)

    def best(self, reverse: tuple[bool, bool, bool], low: int, high: int) -> np.ndarray:
        """Best score of a side that starts at each place from ``low`` to ``high``, below zero where there is none."""
        cut = lambda table, place: table[:, low + place : high + place]
        best = np.full((len(self.sizes), max(0, high - low)), -np.inf)
        if not best.size:
            return best
        most, least, risk = np.empty_like(best), np.empty_like(best), np.empty_like(best)
        for outer, gap1, inner in product(LENGTHS, GAPS, LENGTHS):
            tm = cut(self.tm[outer], 0), cut(self.tm[inner], outer + gap1)
            top, bottom = np.maximum(*tm), np.minimum(*tm)
            risks = cut(self.risk[outer, reverse[0]], 0) + cut(self.risk[inner, reverse[1]], outer + gap1)
            for gap2, tail in product(GAPS, LENGTHS):
                place = outer + gap1 + inner + gap2
                np.maximum(top, cut(self.tm[tail], place), out=most)
                np.minimum(bottom, cut(self.tm[tail], place), out=least)
                most -= least
                most *= 3
                np.subtract(100, most, out=most)
                np.add(risks, cut(self.risk[tail, reverse[2]], place), out=risk)
                risk /= 3.0
                risk *= 25
                most -= risk
                most -= (gap1 + gap2) * 0.3
                np.maximum(best, most, out=best)
        return np.where(np.isinf(best), -1.0, np.clip(best, 0, 100))

    def chosen(self, reverse: tuple[bool, bool, bool], rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The first of the best CHOICES of each side that starts at ``starts`` of ``rows``."""
        out = np.empty((len(rows), len(CHOICES)))
        for k, (outer, gap1, inner, gap2, tail) in enumerate(CHOICES):
            places = (starts, starts + outer + gap1, starts + outer + gap1 + inner + gap2)
            own = list(zip((outer, inner, tail), reverse, places, strict=True))
            tm = [self.tm[n][rows, p] for n, _, p in own]
            risk = sum(self.risk[n, r][rows, p] for n, r, p in own) / 3.0
            out[:, k] = 100 - (np.maximum(np.maximum(tm[0], tm[1]), tm[2]) - np.minimum(np.minimum(tm[0], tm[1]), tm[2])) * 3 - risk * 25 - (gap1 + gap2) * 0.3
        return np.where(np.isinf(out), -1.0, np.clip(out, 0, 100)).argmax(axis=1)


def _pieces_of(template: str, start: int, choice: int, reverse: tuple[bool, bool, bool]) -> list[tuple[str, int, int]]:
    outer, gap1, inner, gap2, tail = CHOICES[choice]
    places = (start, start + outer + gap1, start + outer + gap1 + inner + gap2)
    return [(turned(template[p : p + n]) if r else template[p : p + n], p, p + n) for p, n, r in zip(places, (outer, inner, tail), reverse, strict=True)]


def best_side(template: str, first: int, scan: int, reverse: tuple[bool, bool, bool]) -> dict | None:
    """Outer, inner and tail piece, in this order from ``first`` on, with the best score; ties to the first in place."""
    sides = Sides([template])
    scores = sides.best(reverse, first, min(first + scan, len(template)))[0]
    if not len(scores) or scores.max() < 0:
        return None
    start = first + int(scores.argmax())
    choice = int(sides.chosen(reverse, np.array([0]), np.array([start]))[0])
    return {"pieces": _pieces_of(template, start, choice, reverse), "score": float(scores.max())}


def loop_primer(template: str, first: int, end: int, reverse: bool) -> str | None:
    """The piece of 18 or 20 bases between ``first`` and ``end`` with the least hairpin risk, every fourth start tried."""
    if end - first < 15:
        return None
    found = []
    for n in (18, 20):
        if first + n <= end:
            starts = range(first, first + min(20, end - first - n) + 1, 4)
            own, _, risk = pieces(template, starts, n, reverse)
            found += [(r, x) for x, r in zip(own, risk, strict=True) if x]
    return min(found, key=lambda f: f[0])[1] if found else None


def dimers(left: list[str], right: list[str]) -> np.ndarray:
    """``cross_dimers`` of pairs of pieces of any lengths up to 64, all at once."""
    texts = [x.encode("ascii", "replace") for x in left], [turned(x).encode("ascii", "replace") for x in right]
    letters = [np.frombuffer(b"".join(t), np.uint8) for t in texts]
    sizes = [np.array([len(x) for x in t], np.int64) for t in texts]
    alphabet = np.union1d(*letters)
    bits = [marks(x, np.cumsum(n) - n, n, alphabet) for x, n in zip(letters, sizes, strict=True)]
    longest = int(sizes[0].max(initial=0))
    return crossed(*bits, sizes[0], np.arange(1 - longest, longest)) / sizes[0]


def reach(most: int) -> int:
    """Letters of a template that a set can lie in, where ``most`` starts of a side are searched."""
    return 2 * (most + SIDE) + CORES[-1]


def designs(templates: list[str], top: int = 6, most: int | None = STARTS[1]) -> list[list[tuple]]:
    """Primer sets of each template, best first: rows of SCHEMA without doc_id and rank.

    Each side is searched over half the template, or over ``most`` starts of it if these are fewer.
    """
    out: list[list[tuple]] = [[] for _ in templates]
    long = [k for k, t in enumerate(templates) if len(t) >= LEAST]
    long.sort(key=lambda k: len(templates[k]))  # rows of like width stand together
    at = 0
    while at < len(long):
        end = at + 1
        while end < min(at + PART, len(long)) and (end + 1 - at) * min(len(templates[long[end]]), PART_LETTERS if most is None else reach(most)) <= PART_LETTERS:
            end += 1
        for k, sets in zip(long[at:end], _designed([templates[k] for k in long[at:end]], top, most), strict=True):
            out[k] = sets
        at = end
    return out


def _designed(templates: list[str], top: int, most: int | None) -> list[list[tuple]]:
    sides = Sides(templates if most is None else [t[: reach(most)] for t in templates])
    sizes = [len(t) for t in templates]
    scans = [max(int(n * 0.5 + 0.5), STARTS[0]) if most is None else min(max(int(n * 0.5 + 0.5), STARTS[0]), most) for n in sizes]
    scores = sides.best(FRONT, 0, max(scans))
    starts = [int(own[: min(scan, n)].argmax()) for own, scan, n in zip(scores, scans, sizes, strict=True)]
    fronts = sides.chosen(FRONT, np.arange(len(templates)), np.array(starts))
    wanted = []  # template, core, begin and end of the starts of its second side
    for k, (template, start, choice) in enumerate(zip(templates, starts, fronts.tolist(), strict=True)):
        if scores[k, start] >= 0:
            end = _pieces_of(template, start, choice, FRONT)[2][2]
            wanted += [(k, end + core, min(sizes[k], end + core + max(STARTS[0], min(sizes[k] - end - core, scans[k])))) for core in CORES if end + core < sizes[k] - 3 * LENGTHS[0]]
    if not wanted:
        return [[] for _ in templates]
    low, high = min(w[1] for w in wanted), max(w[2] for w in wanted)
    second = sides.best(BACK, low, high)
    found = [(k, begin + int(own.argmax()), float(own.max())) for k, begin, end in wanted for own in [second[k, begin - low : end - low]]]
    found = [f for f in found if f[2] >= 0]
    backs = sides.chosen(BACK, np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64))
    both = [(k, score, _pieces_of(templates[k], starts[k], int(fronts[k]), FRONT), _pieces_of(templates[k], start, int(choice), BACK)) for (k, start, score), choice in zip(found, backs, strict=True)]
    risks = dimers([f[2][0] + f[1][0] for _, _, f, _ in both], [b[0][0] + b[1][0] for _, _, _, b in both]) if both else []
    sets: list[list[tuple]] = [[] for _ in templates]
    for (k, score, front, back), dimer in zip(both, risks, strict=True):
        (f3, f3_start, _), (f2, _, f2_end), (f1c, f1_start, f1_end) = front
        (b1, b1_start, b1_end), (b2, b2_start, _), (b3, _, b3_end) = back
        lf, lb = loop_primer(templates[k], f2_end, f1_start, True), loop_primer(templates[k], b1_end, b2_start, False)
        points = [_tm(x) for x in (f3, f2, f1c, b1, b2, b3)]
        total = (float(scores[k, starts[k]]) + score) / 2 - (max(points) - min(points)) * 1.5 - float(dimer) * 15 + (5 if lf and lb else 0)
        sets[k].append((b1_start - f1_end, f3, f2, f1c, b1, b2, b3, f1c + f2, b1 + b2, lf, lb, f3_start, b3_end, min(max(total, 0.0), 100.0)))
    return [sorted(own, key=lambda s: -s[-1])[:top] for own in sets]


def design(template: str, top: int = 6, most: int | None = STARTS[1]) -> list[tuple]:
    """Primer sets of a template, best first: rows of SCHEMA without doc_id and rank."""
    return designs([template], top, most)[0]


def lamp_sets(templates: DataFrame, top: int = 6, most: int | None = None) -> DataFrame:
    """The ``top`` primer sets of each (doc_id, seq); null, empty and short templates have none. Ties go by core size.

    All starts of a template are searched, or ``most`` of each side.
    """
    fields = [f.split() for f in SCHEMA.split(", ")]
    schema = pa.schema([(name, pa.int64() if kind == "long" else ARROW[kind]) for name, kind in fields])

    def run(batches):
        for batch in batches:
            made = zip(batch.column("doc_id").to_pylist(), designs(batch.column("seq").to_pylist(), top, most), strict=True)
            rows = [(doc_id, rank, *s[:-1], round(s[-1], 6)) for doc_id, sets in made for rank, s in enumerate(sets, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(fields), schema.types, strict=True)], schema=schema)

    return templates.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("seq").cast("string"), F.lit("")).alias("seq")).mapInArrow(run, SCHEMA)
