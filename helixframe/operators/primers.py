"""PCR primers: all starts and lengths of a template at once, in arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_COMPLEMENT = str.maketrans("ACGT", "TGCA")


def _batches(texts: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, letters, letters of the reverse complement) for each length of primer."""
    lengths = texts.str.len().to_numpy()
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        own = texts.iloc[rows]
        letters = lambda t: np.frombuffer("".join(t).encode("ascii", "replace"), np.uint8).reshape(-1, n)  # noqa: B023, E731
        yield rows, letters(own), letters(own.map(lambda x: x[::-1].translate(_COMPLEMENT)))


def hairpins(texts: pd.Series) -> pd.Series:
    """Share of each primer in its longest run that is complementary to a part more than three bases off."""
    out = np.zeros(len(texts))
    for rows, p, r in _batches(texts):
        n, best = p.shape[1], np.zeros(len(rows), np.int64)
        for shift in [d for d in range(1 - n, n) if abs(d) > 3]:
            run = np.zeros(len(rows), np.int64)
            for i in range(min(n, n - shift) - 1, max(0, -shift) - 1, -1):
                run = (run + 1) * (p[:, i] == r[:, i + shift])
                if i < n - 3:
                    np.maximum(best, run, out=best)
        out[rows] = best / n
    return pd.Series(out)


def self_dimers(texts: pd.Series) -> pd.Series:
    """Greatest share of each primer's bases that pair with the primer itself at one shift."""
    out = np.zeros(len(texts))
    for rows, p, r in _batches(texts):
        n = p.shape[1]
        out[rows] = np.max([(p[:, max(0, s) : n + min(0, s)] == r[:, max(0, -s) : n - max(0, s)]).sum(axis=1) for s in range(1 - n, n)], axis=0) / n
    return pd.Series(out)


def cross_dimers(left: pd.Series, right: pd.Series) -> pd.Series:
    """Greatest share of the bases of ``left`` that pair with ``right`` at one shift."""
    out = np.zeros(len(left))
    sizes = pd.DataFrame({"n": left.str.len(), "m": right.str.len()}).reset_index(drop=True)
    for (n, m), rows in sizes.groupby(["n", "m"]).groups.items():
        if n == 0 or m == 0:
            continue
        letters = lambda t, k: np.frombuffer("".join(t).encode("ascii", "replace"), np.uint8).reshape(-1, k)
        p, r = letters(left.iloc[rows], n), letters(right.iloc[rows].map(lambda x: x[::-1].translate(_COMPLEMENT)), m)
        shared = [(p[:, max(0, -s) : min(n, m - s)] == r[:, max(0, s) : min(m, n + s)]).sum(axis=1) for s in range(1 - n, n) if min(n, m - s) > max(0, -s)]
        out[rows] = np.minimum(np.max(shared, axis=0) / n, 1.0)
    return pd.Series(out)


# What a score loses a percent of GC outside its range, a degree outside its range, and for the two risks.
GC_RANGE, GC_LOSS, TM_RANGE, TM_LOSS, HAIRPIN_LOSS, DIMER_LOSS = (40.0, 60.0), 1.5, (55.0, 65.0), 1.2, 30, 20
GC_LIMITS, LEAST_SCORE, REPEAT, LOOP = (30, 70), 40, 5, 3
TURN = np.arange(256, dtype=np.uint8)
TURN[list(b"ACGT")] = list(b"TGCA")


class Windows:
    """Pairing of a template's windows with themselves, each length from the one shorter by two, for all starts at once.

    A primer that lies on itself at some shift pairs its letters around one centre, and so does each window around that
    centre: ``paired`` counts the letters of each window of n that stand against their complement, ``run`` has the longest
    run of them. A primer's risks are the greatest of the windows that share one of its ends, so they are kept as greatest
    values of all windows so far from each start and to each end. Templates may stand one after the other: a window's
    values depend on its own letters only. Risks of windows of ``shortest`` to ``longest`` letters are kept.
    """

    def __init__(self, letters: np.ndarray, longest: int, shortest: int = 1) -> None:
        size, turned = len(letters), TURN[letters]
        none = np.zeros(size + 1, np.int8)
        self._dimers: dict[int, np.ndarray] = {}
        self._hairpins = {n: none[: size - n + 1] for n in range(1, min(LOOP + 1, longest, size) + 1)}
        paired, edges, runs = [none, none], [none, none], [none, none]  # of the two lengths before
        dimer_from, dimer_to, hairpin_from, hairpin_to = none, none, none, none
        for n in range(1, min(longest, size) + 1):
            count, inner = size - n + 1, slice(1, size - n + 2)
            ends = letters[:count] == turned[n - 1 :]
            if n == 1:
                own_paired, own_edge, own_run = (ends.astype(np.int8) for _ in range(3))
            else:
                before = edges[0][inner]
                own_paired = paired[0][inner] + 2 * ends.astype(np.int8)
                own_edge = (before + np.int8(1) + (before == n - 2)) * ends
                own_run = np.maximum(runs[0][inner], own_edge)
            paired, edges, runs = [paired[1], own_paired], [edges[1], own_edge], [runs[1], own_run]
            dimer_from, dimer_to = np.maximum(dimer_from[:count], own_paired), np.maximum(dimer_to[1 : count + 1], own_paired)
            hairpin_from, hairpin_to = np.maximum(hairpin_from[:count], own_run), hairpin_to[1 : count + 1]
            if n >= 4:  # shorter windows at the end hold runs that begin too late only, those below seven some of them
                hairpin_to = np.maximum(hairpin_to, own_run if n >= 7 else self._early_run(letters, turned, n))
            if n >= shortest:
                self._dimers[n] = np.maximum(dimer_from, dimer_to)
            if n + LOOP + 1 >= shortest and n + LOOP + 1 <= min(longest, size):
                whole = size - n - LOOP
                self._hairpins[n + LOOP + 1] = np.maximum(hairpin_from[:whole], hairpin_to[LOOP + 1 : LOOP + 1 + whole])

    @staticmethod
    def _early_run(letters: np.ndarray, turned: np.ndarray, n: int) -> np.ndarray:
        """Longest run around the middle of each window of n that begins no later than four letters from its end."""
        count = len(letters) - n + 1
        run, best = np.zeros(count, np.int8), np.zeros(count, np.int8)
        for x in range(n - 1, -1, -1):
            run = (run + np.int8(1)) * (letters[x : x + count] == turned[n - 1 - x : n - 1 - x + count])
            if x <= n - 4:
                np.maximum(best, run, out=best)
        return best

    def dimers(self, n: int) -> np.ndarray:
        """Most letters of each window of n that pair with the window itself at one shift."""
        return self._dimers[n]

    def hairpins(self, n: int) -> np.ndarray:
        """Longest run of each window of n, from no later than its fourth letter from the end, that pairs with the window
        more than LOOP letters off."""
        return self._hairpins[n]


@lru_cache(64)
def _scores(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gc, tm, score) of a primer of n by its G and C, below 14 bases also its A and T; scores by both risks too, below
    zero where it is not acceptable."""
    off = lambda x, bounds: np.maximum(np.maximum(bounds[0] - x, x - bounds[1]), 0.0)
    strong, weak, own = np.arange(n + 1)[:, None], np.arange(n + 1 if n < 14 else 1)[None, :], np.arange(n + 1)
    gc = strong * 100.0 / n + 0.0 * weak
    tm = 81.5 + 0.41 * gc - 675.0 / n if n >= 14 else 2.0 * weak + 4.0 * strong
    score = (100 - GC_LOSS * off(gc, GC_RANGE) - TM_LOSS * off(tm, TM_RANGE))[..., None, None] - (HAIRPIN_LOSS * (own / n))[:, None] - DIMER_LOSS * (own / n)
    score = np.clip(score, 0.0, 100.0)
    good = ((gc >= GC_LIMITS[0]) & (gc <= GC_LIMITS[1]))[..., None, None] & (score >= LEAST_SCORE)
    return gc.ravel(), tm.ravel(), np.where(good, score, -1.0).ravel()


#: Letters of the templates that are worked together: their arrays stay in a core's cache.
PART_LETTERS = 65_536


def _best_of(letters: np.ndarray, ends: np.ndarray, shortest: int, longest: int, top: int) -> list[tuple[np.ndarray, ...]]:
    """(starts, lengths, gc, tm, score) of the ``top`` acceptable primers of each of the templates that end at ``ends``."""
    size, lengths = len(letters), range(shortest, min(longest, len(letters)) + 1)
    if not lengths:
        none = np.zeros(0)
        return [(none.astype(np.int64), none.astype(np.int64), none, none, none)] * len(ends)
    windows = Windows(letters, longest, shortest)
    counts = lambda marks: np.concatenate([[0], np.cumsum(marks, dtype=np.int32)]).astype(np.int32)
    strong, weak = counts((letters == ord("G")) | (letters == ord("C"))), counts((letters == ord("A")) | (letters == ord("T")))
    run = np.isin(letters, np.frombuffer(b"ACGT", np.uint8))[: max(0, size - REPEAT + 1)]
    for x in range(1, REPEAT):
        run = run & (letters[x : x + len(run)] == letters[: len(run)])
    runs = counts(run)  # runs that begin before each place
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(size)  # letters from each place to its template's end
    kinds, scores = np.zeros((size, len(lengths)), np.int32), np.full((size, len(lengths)), -1.0)
    all_gc, all_tm, offset = [], [], 0
    for k, n in enumerate(lengths):
        count = size - n + 1
        kind = strong[n:] - strong[:-n]
        if n < 14:
            kind = kind * (n + 1) + (weak[n:] - weak[:-n])
        gc, tm, table = _scores(n)
        own = table[(kind * (n + 1) + windows.hairpins(n)) * (n + 1) + windows.dimers(n)]
        kinds[:count, k] = kind + offset
        all_gc, all_tm, offset = [*all_gc, gc], [*all_tm, tm], offset + len(gc)
        own[left[:count] < n] = -1.0
        if n >= REPEAT:
            own[runs[n - REPEAT + 1 :][:count] > runs[:count]] = -1.0
        scores[:count, k] = own
    all_gc, all_tm = np.concatenate(all_gc), np.concatenate(all_tm)
    found, first = [], 0
    for end in ends.tolist():
        flat = scores[first:end].ravel()
        least = max(0.0, np.partition(flat, len(flat) - top)[len(flat) - top]) if 0 < top < len(flat) else 0.0
        at = np.flatnonzero(flat >= least)  # those that can be among the best, ties included
        at = at[np.argsort(-flat[at], kind="stable")][:top]
        starts, k = np.divmod(at, len(lengths))
        kind = kinds[first + starts, k]
        found.append((starts, k + shortest, all_gc[kind], all_tm[kind], flat[at]))
        first = end
    return found


def best_of_strands(templates: list[str], shortest: int, longest: int, top: int) -> Iterator[tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]]:
    """(starts, lengths, gc, tm, score) of both strands' best primers of each template, worked PART_LETTERS at a time."""
    part, letters = [], 0
    for k, text in enumerate(templates):
        part.append(text)
        letters += len(text)
        if letters >= PART_LETTERS or k == len(templates) - 1:
            own = np.frombuffer("".join(part).encode("latin-1", "replace"), np.uint8)
            ends = np.cumsum([len(t) for t in part])
            forward = _best_of(own, ends, shortest, longest, top)
            backward = _best_of(TURN[own][::-1].copy(), np.cumsum([len(t) for t in part[::-1]]), shortest, longest, top)
            yield from zip(forward, backward[::-1], strict=True)
            part, letters = [], 0


def best_primers(template: str, shortest: int, longest: int, top: int) -> list[tuple[int, str, float, float, float]]:
    """(start, primer, gc, tm, score) of the ``top`` acceptable primers; ties by start, then length."""
    letters = np.frombuffer(template.encode("latin-1", "replace"), np.uint8)
    own = _best_of(letters, np.array([len(letters)]), shortest, longest, top)[0]
    return [(start, template[start : start + n], gc, tm, score) for start, n, gc, tm, score in zip(*(x.tolist() for x in own), strict=True)]


ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}


def _rows(templates: DataFrame, fields: str, work: Callable[[list[str]], Iterator[tuple[list, ...]]]) -> DataFrame:
    """doc_id with the rows of ``fields`` that ``work`` makes of each template's text, row by row in Arrow batches."""
    own = templates.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("seq").cast("string"), F.lit("")).alias("seq"))
    schema = pa.schema([("doc_id", pa.int64()), *((name, ARROW[kind]) for name, kind in (f.split() for f in fields.split(", ")))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, rows = [[] for _ in schema.names[1:]], []
            for found in work(batch.column("seq").to_pylist()):
                rows.append(len(found[0]))
                for cell, values in zip(cells, found, strict=True):
                    cell += values
            ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(rows)), rows)))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cells, schema.types[1:], strict=True))], schema=schema)

    return own.mapInArrow(run, "doc_id long, " + fields)


def candidates(templates: DataFrame, shortest: int = 18, longest: int = 24, top: int = 60) -> DataFrame:
    """The ``top`` scored primers of each strand of each (doc_id, seq): start, primer, gc, tm, score, rank; ties by start
    and length. Null, empty and short templates have none. Worked row by row in Arrow batches, linear in a template."""

    def work(texts: list[str]) -> Iterator[tuple[list, ...]]:
        for text, both in zip(texts, best_of_strands(texts, shortest, longest, top), strict=True):
            strands, primers, rest = [], [], [[], [], [], []]
            for strand, own, (starts, lengths, *values) in zip("+-", (text, text[::-1].translate(_COMPLEMENT)), both, strict=True):
                strands += strand * len(starts)
                primers += [own[s : s + n] for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                for cell, x in zip(rest, (starts, *values), strict=True):
                    cell += x.tolist()
            ranks = [rank for own in both for rank in range(1, len(own[0]) + 1)]
            yield strands, rest[0], primers, *rest[1:], ranks

    return _rows(templates, "strand string, start int, primer string, gc double, tm double, score double, rank int", work)


def marks(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """For each letter and piece the places of the letter, as bits."""
    place = np.arange(lengths.max(initial=0))
    own = np.where(place < lengths[:, None], letters[np.minimum(starts[:, None] + place, len(letters) - 1)], 0)
    return ((own == alphabet[:, None, None]) * (np.uint64(1) << place.astype(np.uint64))).sum(axis=2, dtype=np.uint64)


def crossed(forward: np.ndarray, backward: np.ndarray, lengths: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Most letters of each pair that pair at one of ``shifts``, from the bits of their letters (see marks), ``backward``
    turned; no piece of ``lengths`` is shifted by its own length or more."""
    down, up = (np.maximum(0, x).astype(forward.dtype)[:, None, None] for x in (-shifts, shifts))
    both = np.bitwise_or.reduce((forward >> down) & (backward >> up), axis=1)
    return (np.bitwise_count(both) * (shifts[:, None] < lengths)).max(axis=0, initial=0)


def best_pairs(text: str, forward: tuple[np.ndarray, ...], backward: tuple[np.ndarray, ...], shortest: int, longest: int, top: int) -> list[tuple]:
    """Rows of the ``top`` pairs of a template's primers (starts, lengths, gc, tm, score), best first."""
    (starts, lengths, _, tm, score), (r_starts, r_lengths, _, r_tm, r_score) = forward, backward
    ends = len(text) - r_starts
    product, gap = ends - starts[:, None], np.abs(tm[:, None] - r_tm)
    good = (product >= shortest) & (product <= longest) & (gap <= 5)
    if not good.any():
        return []
    letters = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
    alphabet, (i, j) = np.unique(letters), np.nonzero(good)
    own, other = marks(letters, starts, lengths, alphabet)[:, i], marks(letters, ends - r_lengths, r_lengths, alphabet)[:, j]
    n, base, longest = lengths[i], (score[i] + r_score[j]) / 2 - 2 * gap[i, j], int(lengths.max())
    shifts = np.arange(1 - longest, longest)
    shifts = shifts[np.argsort(np.abs(shifts), kind="stable")]

    def paired(at: np.ndarray, shifts: np.ndarray, most: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        most = np.maximum(most, crossed(own[:, at], other[:, at], n[at], shifts))
        return np.clip(base[at] - 15 * (most / n[at]), 0.0, 100.0), most

    # Dimers only take from the base: what is below the last of the best by then cannot come among them.
    order = np.argsort(-base, kind="stable")
    first, rest = order[: 6 * top], order[6 * top :]
    pair, _ = paired(first, shifts)
    if len(rest):
        least = np.partition(pair, len(pair) - top)[len(pair) - top] - 1e-6
        rest, most = rest[base[rest] >= least], 0
        for part in (shifts[:8], shifts[8:]):
            bound, most = paired(rest, part, most)
            rest, most, bound = rest[bound >= least], most[bound >= least], bound[bound >= least]
        first, pair = np.concatenate([first, rest]), np.concatenate([pair, bound])
    tied = np.round(pair, 9)
    least = np.partition(tied, len(tied) - top)[len(tied) - top] if top < len(tied) else 0.0
    found = []
    for x in np.flatnonzero(tied >= least).tolist():
        f, r = i[first[x]], j[first[x]]
        start, end = int(starts[f]), int(ends[r])
        primer, turned = text[start : start + int(lengths[f])], text[end - int(r_lengths[r]) : end][::-1].translate(_COMPLEMENT)
        found.append((-tied[x], start, end, primer, turned, float(pair[x]), f, r))
    rows = enumerate(sorted(found)[:top], 1)
    return [(s, f, float(tm[x]), float(score[x]), e, r, float(r_tm[y]), float(r_score[y]), e - s, value, rank) for rank, (_, s, e, f, r, value, x, y) in rows]


def primer_pairs(templates: DataFrame, shortest_product: int = 100, longest_product: int = 1000, top: int = 10) -> DataFrame:
    """The ``top`` pairs of each template's candidates: product within bounds, melting points within five degrees. Scores
    that agree to nine places tie. A template's pairs are scored in the task that has its row; nothing is shuffled."""

    def work(texts: list[str]) -> Iterator[tuple[list, ...]]:
        for text, (forward, backward) in zip(texts, best_of_strands(texts, 18, 24, 60), strict=True):
            rows = best_pairs(text, forward, backward, shortest_product, longest_product, top)
            yield tuple(map(list, zip(*rows, strict=True))) if rows else ([],) * 11

    fields = "f_start int, forward string, f_tm double, f_score double, r_end int, reverse string, r_tm double, r_score double, product int, pair_score double, rank int"
    return _rows(templates, fields, work)
