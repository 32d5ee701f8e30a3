"""Sequence views over ``documents``, the same in Spark and in SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.letters import translated
from helixframe.functions.sequence import LOWER, UPPER
from helixframe.functions.tables import RESIDUES
from helixframe.operators.storage import spread

#: Each letter folded to a base, A, C, G and T to themselves.
FOLD = "ACCTATGACTACGTACGTATGCACGT"[:26]
BARCODES = [(1, "SampleA", "ACGT"), (2, "SampleB", "TTGG"), (3, "SampleC", "GGCA"), (4, "SampleD", "CATC")]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _letters() -> Column:
    return translated(F.col("text"), LOWER + UPPER, UPPER + UPPER)


def bases() -> Column:
    """The letters of the column ``text`` folded to bases."""
    return translated(F.col("text"), LOWER + UPPER, FOLD + FOLD)


def text_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, seq): the letters of the text folded to bases; near-duplicates stay similar."""
    return read(spark, sf_dir, "documents").select("doc_id", "lang", bases().alias("seq"))


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to tasks, for work that weighs more than moving its input."""
    return spread(df, "doc_id")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, seq, qual): the bases of text_dna, with a quality of 12 to 40 from each letter."""
    return reads_of(read(spark, sf_dir, "documents"))


def reads_of(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "lang", bases().alias("seq"), letter_qualities(_letters()).alias("qual"))  # one Python worker makes both


def letter_qualities(letters: Column) -> Column:
    """A quality of 12 to 40 from each of the letters A to Z."""
    table = (12 + (7 * (np.arange(256) - 64)) % 29).astype(np.int32)

    @F.arrow_udf("array<int>")
    def run(own: pa.Array) -> pa.Array:
        texts = own.cast(pa.binary())
        ends = np.cumsum(np.concatenate([[0], pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)])).astype(np.int32)
        values = table[np.frombuffer(b"".join(x for x in texts.to_pylist() if x), np.uint8)]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=own.is_null())

    return run(letters)


def text_protein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, seq): the residue letters of the text."""
    return read(spark, sf_dir, "documents").select("doc_id", "lang", translated(F.col("text"), RESIDUES.lower() + RESIDUES, RESIDUES + RESIDUES).alias("seq"))


_SQL_UPPER = f"translate(coalesce(text, ''), '{LOWER}', '{UPPER}')"
_SQL_LETTERS = f"regexp_replace({_SQL_UPPER}, '[^A-Z]', '', 'g')"
SQL_VIEWS = {
    "reads": f"SELECT doc_id, lang, translate(l, '{UPPER}', '{FOLD}') AS seq, CASE WHEN l = '' THEN []::INT[] ELSE list_transform(string_split(l, ''), lambda c: (12 + (7 * instr('{UPPER}', c)) % 29)::INT) END AS qual FROM (SELECT doc_id, lang, {_SQL_LETTERS} AS l FROM documents)",
    "text_dna": f"SELECT doc_id, lang, translate({_SQL_LETTERS}, '{UPPER}', '{FOLD}') AS seq FROM documents",
    "text_protein": f"SELECT doc_id, lang, regexp_replace({_SQL_UPPER}, '[^{RESIDUES}]', '', 'g') AS seq FROM documents",
    "barcodes": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', '{b}')" for i, n, b in BARCODES) + ") AS t(idx, sample, barcode)",
}


def sql(view: str, body: str, *more: str) -> str:
    """``body`` over ``view`` (as ``v``) and further views by their own names."""
    return "WITH RECURSIVE " + ", ".join([f"v AS ({SQL_VIEWS[view]})", *(f"{m} AS ({SQL_VIEWS[m]})" for m in more)]) + " " + body
