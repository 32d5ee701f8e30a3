"""Queries of the document store: damaged lines, upserts, quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from helixframe.operators.storage import shared_path
from helixframe.plans import views
from helixframe.sources.store import Store

SCHEMA = StructType().add("doc_id", LongType()).add("lang", StringType()).add("n_chars", LongType())


def document_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of all documents whose lines are cut in half where the length divides by seven, after an upsert of the
    English ones: what it holds, and a row without fields for each line that was corrupt, in the store or in quarantine.
    """
    documents = views.read(spark, sf_dir, "documents").select(*(F.col(c).cast(SCHEMA[c].dataType).alias(c) for c in SCHEMA.names)).where("doc_id IS NOT NULL")
    store = Store(shared_path(spark, "documents"), SCHEMA, "doc_id")
    lines = documents.select(F.to_json(F.struct("*")).alias("line"), (F.col("n_chars") % 7 == 0).alias("cut"), store.bucket(F.col("doc_id")).alias("bucket"))
    written = lines.select(F.expr("CASE WHEN cut THEN substr(line, 1, length(line) div 2) ELSE line END").alias("value"), "bucket")
    written.repartition("bucket").write.partitionBy("bucket").text(store.path)
    store.upsert(documents.where("lang = 'en'").withColumn("lang", F.upper("lang")))
    lost = store.corrupt(spark).unionByName(store.quarantined(spark))
    return store.read(spark).select("*", F.lit(False).alias("corrupt")).unionByName(lost.select(*(F.lit(None).cast(SCHEMA[c].dataType).alias(c) for c in SCHEMA.names), F.lit(True).alias("corrupt")))


QUERIES = {"document_store": document_store}
SQL = {
    "document_store": """WITH d AS (SELECT doc_id, lang, n_chars::BIGINT AS n_chars, coalesce(n_chars % 7 = 0, false) AS cut, coalesce(lang = 'en', false) AS en FROM documents WHERE doc_id IS NOT NULL)
    SELECT doc_id, CASE WHEN en THEN upper(lang) ELSE lang END AS lang, n_chars, false AS corrupt FROM d WHERE en OR NOT cut UNION ALL SELECT NULL, NULL, NULL, true FROM d WHERE cut"""
}
