"""Column functions of protein sequences, from residue counts."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from helixframe.functions.letters import counts_of
from helixframe.functions.sequence import ascii_upper, count_of
from helixframe.functions.tables import C_TERM_PKA, HELIX, HYDROPATHY, N_TERM_PKA, NEGATIVE_PKA, POSITIVE_PKA, RESIDUE_MASS, RESIDUES, SHEET, TURN, UNKNOWN_RESIDUE_MASS, WATER_MASS


def clean_protein(s: Column) -> Column:
    return F.regexp_replace(ascii_upper(s), f"[^{RESIDUES}]", "")


def _known(count: Callable[[str], Column], scale: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [count(r) * F.lit(v) for r, v in scale.items()])


def weighted(s: Column, scale: dict[str, float], unknown: float = 0.0) -> Column:
    """Sum of the residues' values."""
    known = _known(partial(count_of, s), scale)
    return known + (F.length(s) - F.length(F.regexp_replace(s, f"[^{RESIDUES}]", ""))) * F.lit(unknown) if unknown else known


def molecular_weight(s: Column) -> Column:
    return F.when(F.length(s) == 0, 0.0).otherwise(F.lit(WATER_MASS) + weighted(s, RESIDUE_MASS, UNKNOWN_RESIDUE_MASS))


def mean_of(s: Column, scale: dict[str, float], empty: float = 0.0) -> Column:
    return F.when(F.length(s) == 0, empty).otherwise(weighted(s, scale) / F.length(s))


def gravy(s: Column) -> Column:
    return mean_of(s, HYDROPATHY)


def aliphatic_index(s: Column) -> Column:
    return _aliphatic(F.length(s), partial(count_of, s))


def _aliphatic(n: Column, count: Callable[[str], Column]) -> Column:
    return F.when(n == 0, 0.0).otherwise((count("A") + 2.9 * count("V") + 3.9 * (count("I") + count("L"))) * 100.0 / n)


def extinction_coefficient(s: Column) -> Column:
    return 5500 * count_of(s, "W") + 1490 * count_of(s, "Y") + 125 * F.floor(count_of(s, "C") / 2)


@F.pandas_udf(DoubleType())
def isoelectric_point(protein: pd.Series) -> pd.Series:
    """The pH without net charge, by 60 bisections on 0 to 14 for all rows at once; 7 where empty."""
    return pd.Series(_isoelectric({r: protein.str.count(r).to_numpy(float) for r in "KRHDECY"}, protein.str.len().to_numpy()))


def _isoelectric(counts: dict[str, np.ndarray], lengths: np.ndarray) -> np.ndarray:
    low, high = np.zeros(len(lengths)), np.full(len(lengths), 14.0)
    for _ in range(60):
        ph = (low + high) / 2
        charge = 1 / (1 + 10 ** (ph - N_TERM_PKA)) - 1 / (1 + 10 ** (C_TERM_PKA - ph))
        charge += sum(counts[r] / (1 + 10 ** (ph - k)) for r, k in POSITIVE_PKA.items()) - sum(counts[r] / (1 + 10 ** (k - ph)) for r, k in NEGATIVE_PKA.items())
        low, high = np.where(charge > 0, ph, low), np.where(charge > 0, high, ph)
    return np.where(lengths == 0, 7.0, (low + high) / 2)


def residue_counts(s: Column) -> Column:
    """Numbers of each of RESIDUES; other letters of the text do not count."""
    return counts_of(s, RESIDUES)


@F.arrow_udf(DoubleType())
def _counted_point(counts: pa.Array) -> pa.Array:
    own = counts.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(RESIDUES))
    return pa.array(_isoelectric({r: own[:, RESIDUES.index(r)].astype(float) for r in "KRHDECY"}, own.sum(axis=1)))


def counted_numbers(counts: Column) -> dict[str, Column]:
    """Residues, weight, hydropathy, aliphatic index and isoelectric point of a clean protein, from its ``residue_counts``
    (no nulls): as those functions have them, without looking at the protein once for each residue."""
    n, count = F.aggregate(counts, F.lit(0), lambda a, x: a + x), lambda r: F.get(counts, F.lit(RESIDUES.index(r)))
    none = n == 0
    return {
        "residues": n, "mw": F.when(none, 0.0).otherwise(F.lit(WATER_MASS) + _known(count, RESIDUE_MASS)), "gravy": F.when(none, 0.0).otherwise(_known(count, HYDROPATHY) / n),
        "aliphatic": _aliphatic(n, count), "pi": _counted_point(counts),
    }


KINDS = {"H": "Helix", "S": "Sheet", "C": "Coil"}


def _kind_table() -> np.ndarray:
    """H, S and C as 0, 1 and 2, by byte: the greatest of a residue's propensities, helix and sheet first."""
    table = np.zeros(256, np.uint8)
    for r in RESIDUES:
        h, e, t = (scale[r] for scale in (HELIX, SHEET, TURN))
        table[ord(r)] = 0 if h >= e and h >= t else 1 if e >= h and e >= t else 2
    return table


def structure(seq: str) -> str:
    """H, S or C of each residue, smoothed to the majority of five neighbours, ties to the first of them."""
    raw = np.pad(_kind_table()[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)], 2, constant_values=3)
    n = len(seq)
    votes, first = np.zeros((3, n), np.int8), np.full((3, n), 9, np.int8)
    for place in range(4, -1, -1):
        for k in range(3):
            own = raw[place : place + n] == k
            votes[k] += own
            first[k][own] = place
    return np.frombuffer(b"HSC", np.uint8)[(first - 10 * votes).argmin(axis=0)].tobytes().decode() if n else ""


@F.pandas_udf(StringType())
def structure_letters(s: pd.Series) -> pd.Series:
    return s.map(structure, na_action="ignore")


def residue_structure(s: Column) -> Column:
    """Array of the class of each residue, as ``structure`` has it."""
    kinds = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    return F.transform(F.filter(F.split(structure_letters(s), ""), lambda c: c != ""), lambda c: F.element_at(kinds, c))
