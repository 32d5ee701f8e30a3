"""Arrow functions of letters: what looks at each letter in turn is worked in array steps over many rows at once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.functions.tables import CODON_AMINO, CODON_BASES

#: Letters that are worked together; a longer row is worked alone.
PART = 1 << 20
#: Places of the bases in the genetic code by byte, 4 for all else; U is T.
BASE = np.full(256, 4, np.uint8)
BASE[[ord(b) for b in CODON_BASES + "U"]] = [0, 1, 2, 3, 0]
_ANY_BASE = BASE.copy()
_ANY_BASE[[ord(b) for b in (CODON_BASES + "U").lower()]] = [0, 1, 2, 3, 0]
#: Residue of three such places as digits to the base five; X where one is no base.
AMINO = np.full(125, ord("X"), np.uint8)
AMINO[[25 * a + 5 * b + c for a in range(4) for b in range(4) for c in range(4)]] = np.frombuffer(CODON_AMINO.encode(), np.uint8)


def ranges(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of rows of these sizes that are worked together."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, PART + (ends[at - 1] if at else 0), "right")))
        yield at, end
        at = end


def parts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points of some rows one after another, place of each row's first and of the end); bytes where all are ASCII."""
    sizes = np.array([len(t) for t in texts], np.int64)
    for at, end in ranges(sizes):
        joined = "".join(texts[at:end])
        codes = np.frombuffer(joined.encode(), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        yield codes, np.concatenate([[0], np.cumsum(sizes[at:end])])


def _texts(own: pa.Array) -> list[str]:
    return [t or "" for t in own.to_pylist()]


def _bytes(codes: np.ndarray) -> np.ndarray:
    """Code points as bytes, 255 for those beyond."""
    return codes if codes.dtype == np.uint8 else np.minimum(codes, 255).astype(np.uint8)


def translated(text: Column, letters: str, to: str) -> Column:
    """Each of ``letters`` (ASCII) turned into the one at its place in ``to``, all else left out; null is empty.

    Not deterministic for the planner only: a filter on the result is not to work it a second time.
    """
    table, others = bytes.maketrans(letters.encode(), to.encode()), bytes(set(range(256)) - set(letters.encode()))

    @F.arrow_udf("string")
    def run(own: pa.Array) -> pa.Array:
        own = own.cast(pa.binary())
        found = [pa.array([], pa.binary())]
        for at, end in ranges(pc.binary_length(own).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)):
            found.append(pa.array([(x or b"").translate(table, others) for x in own.slice(at, end - at).to_pylist()], pa.binary()))
        return pa.concat_arrays(found).cast(pa.string())

    return run.asNondeterministic()(text)


def residues_of_codons(s: Column) -> Column:
    """The residue of each codon in either case: stops are ``*``, unknown codons X, a rest of one or two letters is dropped."""

    @F.arrow_udf("string")
    def run(own: pa.Array) -> pa.Array:
        found, sizes = [np.zeros(0, np.uint8)], [np.zeros(1, np.int64)]
        for codes, places in parts(_texts(own)):
            base, count = _ANY_BASE[_bytes(codes)], np.diff(places) // 3
            at = np.repeat(places[:-1] - 3 * (np.cumsum(count) - count), count) + 3 * np.arange(count.sum())
            found.append(AMINO[25 * base[at] + 5 * base[at + 1] + base[at + 2]])
            sizes.append(count)
        ends = np.cumsum(np.concatenate(sizes)).astype(np.int32)
        whole = pa.StringArray.from_buffers(len(own), pa.py_buffer(ends), pa.py_buffer(np.concatenate(found)))
        return pc.if_else(own.is_null(), pa.scalar(None, pa.string()), whole) if own.null_count else whole

    return run(s)


def counts_of(s: Column, letters: str) -> Column:
    """Array of the numbers of each of ``letters`` (ASCII) in a text; null where it is null."""
    kind = np.full(256, len(letters), np.int64)
    kind[list(letters.encode())] = range(len(letters))
    width = len(letters) + 1

    @F.arrow_udf("array<int>")
    def run(own: pa.Array) -> pa.Array:
        found = [np.zeros((0, width), np.int64)]
        for codes, places in parts(_texts(own)):
            rows = np.repeat(np.arange(len(places) - 1) * width, np.diff(places))
            found.append(np.bincount(rows + kind[_bytes(codes)], minlength=width * (len(places) - 1)).reshape(-1, width))
        values = np.ascontiguousarray(np.concatenate(found)[:, :-1], np.int32)
        places = pa.array(np.arange(len(own) + 1, dtype=np.int32) * len(letters))
        return pa.ListArray.from_arrays(places, pa.array(values.ravel()), mask=own.is_null())

    return run(s)


def _numbers(texts: list[str]) -> Iterator[list[int]]:
    at = 0
    for codes, places in parts(texts):
        own, at = texts[at : at + len(places) - 1], at + len(places) - 1
        if codes.dtype == np.uint8:
            rows = np.repeat(np.arange(len(own)) * 128, np.diff(places))
            for text, counts in zip(own, np.bincount(rows + codes, minlength=128 * len(own)).reshape(-1, 128), strict=True):
                yield [int(counts[c]) for c in sorted(np.flatnonzero(counts).tolist(), key=lambda c: text.find(chr(c)))]
        else:
            yield from (list(Counter(text).values()) for text in own)


def letter_numbers(s: Column) -> Column:
    """Array of the numbers of each different letter of a text, in order of their first places; null where it is null."""

    @F.arrow_udf("array<int>")
    def run(own: pa.Array) -> pa.Array:
        return pa.array(list(_numbers(_texts(own))), pa.list_(pa.int32()), mask=own.is_null().to_numpy(zero_copy_only=False))

    return run(s)


def longest_run(s: Column) -> Column:
    """Length of the longest run of one letter; null where the text is null."""

    @F.arrow_udf("int")
    def run(own: pa.Array) -> pa.Array:
        found = [np.zeros(0, np.int64)]
        for codes, places in parts(_texts(own)):
            most, full = np.zeros(len(places) - 1, np.int64), np.diff(places) > 0
            if len(codes):
                begins = np.concatenate([[True], codes[1:] != codes[:-1]])
                begins[places[:-1][full]] = True
                starts = np.flatnonzero(begins)
                most[full] = np.maximum.reduceat(np.diff(np.append(starts, len(codes))), np.searchsorted(starts, places[:-1][full]))
            found.append(most)
        return pa.array(np.concatenate(found).astype(np.int32), mask=own.is_null().to_numpy(zero_copy_only=False))

    return run(s)
