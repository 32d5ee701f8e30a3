"""The training-data pipeline: stages over documents, each written and read again as the next one's input.

Every stage reads its predecessor's rows, and its decisions take effect; all but the last return the columns of
``documents``, with ``n_chars`` kept true to the text. Decisions hold for rows, not ids: a null or repeated doc_id is a
row like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import queries as llm
from helixframe.llm.common import ROW, materialise, numbered, read, unused, without
from helixframe.llm.decontamination import contaminated
from helixframe.llm.line_dedup import without_frequent_lines
from helixframe.llm.packing import pack
from helixframe.llm.quality_classifier import accepted
from helixframe.llm.simhash import representatives


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null or empty text gets the score of the bias; without labels every row stays. Repeated rows go or stay together,
    null ids like any other row; an empty table stays empty.
    """
    return accepted(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; documents stay, even if nothing is left of them.

    A null text stays null and has no n_chars; an empty one stays. Every row counts as a document, repeated rows and
    null ids too; an empty table stays empty.
    """
    return without_frequent_lines(docs, threshold=10).withColumn("n_chars", F.length("text").cast("long"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Null ids come last, and of rows that tie one stays; texts without words are one group; an empty table stays empty.
    """
    return representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Rows are judged by their own text, null and repeated ids too; null and empty texts hold nothing and stay; without a
    benchmark all rows stay; an empty table stays empty.
    """
    row = unused(docs.columns, ROW)
    rows = numbered(docs, "rows", row)
    found = contaminated(rows.select(F.col(row).alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    return without(rows, found.select(F.col("doc_id").alias(row)), row).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 4096 tokens.

    A null or empty text is a piece of the end id alone; repeated rows and null ids are packed like any other; an empty
    table gives no pieces.
    """
    return pack(docs, llm.WORD_BPE, end_id=1, capacity=4096)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: A trained model, connected components and a tokenizer have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
