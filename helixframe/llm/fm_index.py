"""A compressed index of word sequences: Burrows-Wheeler transform in a wavelet tree, for numpy arrays of queries.

Suffixes are sorted by their first DEPTH symbols, which is enough for patterns up to that length.
"""

from __future__ import annotations

import numpy as np

DEPTH = 64


class BitRank:
    """A packed bit vector with the number of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))[:-1]]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << rest) - np.uint64(1)))


class WaveletTree:
    """Ranks of symbols, a bit vector for each bit of a symbol (zeros of a level stand before its ones)."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.levels: list[tuple[int, BitRank, int]] = []
        for shift in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            bits = ((symbols >> shift) & 1).astype(np.uint8)
            self.levels.append((shift, BitRank(bits), int(len(bits) - bits.sum())))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        self.first = np.zeros(size, np.int64)
        self.first = self.rank(np.arange(size), np.zeros(size, np.int64))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        place = at
        for shift, bits, zeros in self.levels:
            ones = bits.ones(place)
            place = np.where((symbol >> shift) & 1 == 1, zeros + ones, place - ones)
        return place - self.first[symbol]


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


class FMIndex:
    """Index of ``text``: int symbols from 0 to ``size`` - 1, 0 being the separator after each sequence."""

    def __init__(self, text: np.ndarray, size: int, window: int) -> None:
        n, half = len(text), 1 << (window.bit_length() - 1)
        rank, length, at_half = text.astype(np.int64), 1, None
        while True:
            if length == half:
                at_half = rank
            if length >= DEPTH:
                break
            shifted = np.concatenate([rank[length:], np.zeros(min(length, n), np.int64)])[:n]
            rank = _dense(rank * (int(rank.max(initial=0)) + 1) + shifted)
            length *= 2
        self.order = np.argsort(rank, kind="stable")
        later = np.minimum(self.order + window - half, n - 1)
        new = (at_half[self.order][1:] != at_half[self.order][:-1]) | (at_half[later][1:] != at_half[later][:-1])
        #: Rows with the same first ``window`` symbols form a class: an interval cut back to that length is a class.
        edges = np.concatenate([[0], np.flatnonzero(new) + 1, [n]]) if n else np.zeros(1, np.int64)
        self.class_of = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        self.edges = edges
        self.tree = WaveletTree(text[self.order - 1], size)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.window = window

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of symbol + pattern from that of the pattern."""
        return self.starts[symbol] + self.tree.rank(symbol, low), self.starts[symbol] + self.tree.rank(symbol, high)

    def classes(self, stream: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Matching statistics cut at ``window``: for each place of ``stream`` the class of rows that begin with the
        ``window`` symbols there, -1 where the index has no such match or the sequence (begins to ends) is over.

        All sequences go backwards in step. Each holds the interval of its longest match so far, at most ``window``
        long: one more symbol on the left, then back to the class. Where a match breaks off, it starts anew.
        """
        found = np.full(len(stream), -1, np.int64)
        order = np.argsort(begins - ends, kind="stable")
        begins, at = begins[order], ends[order] - 1
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.order), np.int64)
        matched = np.zeros(len(at), np.int64)
        while len(at):
            low, high = self.step(stream[at], low, high)
            matched = matched + 1
            lost = high <= low  # within a shard the stream is indexed, so this befalls foreign streams only
            if lost.any():
                low[lost], high[lost], matched[lost] = self._again(stream, at[lost], matched[lost])
            full = matched >= self.window
            own = self.class_of[low[full]]
            found[at[full]] = own
            low[full], high[full], matched[full] = self.edges[own], self.edges[own + 1], self.window
            at = at - 1
            keep = at >= begins
            begins, at, low, high, matched = (x[keep] for x in (begins, at, low, high, matched))
        return found

    def _again(self, stream: np.ndarray, at: np.ndarray, matched: np.ndarray) -> tuple[np.ndarray, ...]:
        """The longest match from each place on that is shorter than ``matched``: searched anew, symbol by symbol."""
        low, high, best = np.zeros(len(at), np.int64), np.full(len(at), len(self.order), np.int64), np.zeros(len(at), np.int64)
        for i, (place, most) in enumerate(zip(at, matched, strict=True)):
            for length in range(int(most) - 1, 0, -1):
                lo, hi = np.zeros(1, np.int64), np.full(1, len(self.order), np.int64)
                for k in range(place + length - 1, place - 1, -1):
                    lo, hi = self.step(stream[k : k + 1], lo, hi)
                if hi[0] > lo[0]:
                    low[i], high[i], best[i] = lo[0], hi[0], length
                    break
        return low, high, best
