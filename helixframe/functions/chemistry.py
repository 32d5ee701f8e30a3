"""Column functions of sum formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.functions.tables import ATOMIC_WEIGHT, ELEMENTS, MONOISOTOPIC

_PATTERN = r"([A-Z][a-z]?)(\d*)"


def _literal_map(values: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def formula_atoms(formula: Column) -> Column:
    """Array of (symbol, n); a symbol without a number counts once. Brackets are not read."""
    symbols, numbers = (F.regexp_extract_all(formula, F.lit(_PATTERN), F.lit(k)) for k in (1, 2))
    return F.zip_with(symbols, numbers, lambda s, n: F.struct(s.alias("symbol"), F.when(n == "", 1).otherwise(n.try_cast("int")).alias("n")))


def formula_mass(formula: Column, monoisotopic: bool = True) -> Column:
    masses = _literal_map(MONOISOTOPIC if monoisotopic else ATOMIC_WEIGHT)
    return F.aggregate(formula_atoms(formula), F.lit(0.0), lambda a, x: a + x["n"] * F.coalesce(masses[x["symbol"]], F.lit(0.0)))


def formula_known(formula: Column) -> Column:
    atoms = formula_atoms(formula)
    return (F.size(atoms) > 0) & F.forall(atoms, lambda x: x["symbol"].isin(ELEMENTS))
