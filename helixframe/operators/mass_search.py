"""Mass search as a binned range join."""

from __future__ import annotations

from math import log1p

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.tables import ADDUCTS


def mass_search(observed: DataFrame, compounds: DataFrame, adduct: str = "[M+H]+", ppm: float = 20.0) -> DataFrame:
    """Pairs of observed (id, mz) and compounds (compound_id, mass) within ``ppm`` of the theoretical m/z.

    Both sides are binned by the logarithm of m/z with bins as wide as the tolerance, so a match lies in the same or a
    neighbouring bin: an equi-join, whatever the size of either side.
    """
    width = log1p(ppm * 1.001e-6)
    bin_of = lambda c: F.floor(F.log(c) / width)
    known = compounds.withColumn("theoretical", F.col("mass") + ADDUCTS.get(adduct, 0.0)).where("theoretical > 0").withColumn("bin", bin_of(F.col("theoretical")))
    seen = observed.where("mz > 0").withColumn("bin", F.explode(F.array(*(bin_of(F.col("mz")) + d for d in (-1, 0, 1)))))
    error = (F.col("mz") - F.col("theoretical")) / F.col("theoretical") * 1e6
    return seen.join(known, "bin").withColumn("ppm", error).where(F.abs("ppm") <= ppm).drop("bin")
