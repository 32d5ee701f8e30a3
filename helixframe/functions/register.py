"""The library's functions in SQL: scalar ones as temporary SQL functions, k-mers and reading frames as table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

SCALAR = {
    "sanitize_sequence": ("s STRING", "STRING", "regexp_replace(translate(s, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z*-]', '')"),
    "reverse_complement": ("s STRING", "STRING", "reverse(translate(s, 'ACGT', 'TGCA'))"),
    "transcribe": ("s STRING", "STRING", "translate(s, 'T', 'U')"),
    "gc_content": ("s STRING", "DOUBLE", "CASE WHEN s = '' THEN 0D ELSE length(regexp_replace(s, '[^GC]', '')) * 100D / length(s) END"),
    "poly_a_tail": ("s STRING", "INT", "length(s) - length(rtrim('A', s))"),
    "melting_temperature": (
        "s STRING",
        "DOUBLE",
        "CASE WHEN s = '' THEN 0D WHEN length(s) < 14 THEN 2D * length(regexp_replace(s, '[^AT]', '')) + 4D * length(regexp_replace(s, '[^GC]', '')) "
        "ELSE 81.5D + 0.41D * (length(regexp_replace(s, '[^GC]', '')) * 100D / length(s)) - 675D / length(s) END",
    ),
}


@udtf(returnType="pos int, kmer string")
class Kmers:
    """A row for each k-mer of a sequence."""

    def eval(self, seq: str, k: int):
        for i in range(len(seq or "") - k + 1):
            yield i, seq[i : i + k]


@udtf(returnType="strand string, frame int, start int, end int, length int")
class Orfs:
    """A row for each open reading frame of a sequence, the longest first."""

    def eval(self, seq: str, least: int):
        from helixframe.operators.annotation import orf_columns

        minus, frame, start, end, _ = orf_columns(seq or "", least, None)
        for m, f, a, b in zip(minus.tolist(), frame.tolist(), start.tolist(), end.tolist(), strict=True):
            yield "-" if m else "+", f, a, b, b - a


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to ``spark.sql``; returns their names."""
    for name, (arguments, returns, body) in SCALAR.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
    spark.udtf.register("kmers", Kmers)
    spark.udtf.register("orfs", Orfs)
    return [*SCALAR, "kmers", "orfs"]
