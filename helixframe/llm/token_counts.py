"""Token counts by digest cache (operator 8).

Documents are joined by the digest of their content and of the tokenizer file to counts stored in a cache table;
only the distinct contents without a stored count are encoded, and their counts are appended to the cache.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import map_batches, new_table_path
from helixframe.llm.tokenizer_memo import ByteCounts, encoder

CACHE_SCHEMA = "tokenizer string, digest binary, n_bytes long, n_tokens long"


def tokenizer_digest(path: str) -> str:
    import hashlib

    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _encode(texts: DataFrame, path: str, version: str) -> DataFrame:
    def counts(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = batch.column("text").to_pylist()
        n = encoder(ByteCounts, path)(found)
        size = [len(t.encode()) for t in found]
        return pa.RecordBatch.from_arrays(
            [pa.array([version] * len(found), pa.string()), batch.column("digest"), pa.array(size, pa.int64()), pa.array(n, pa.int64())],
            ["tokenizer", "digest", "n_bytes", "n_tokens"],
        )

    return map_batches(texts, counts, CACHE_SCHEMA)


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """The counts of one tokenizer, a row for each digest however often it was appended; None where there is no cache yet."""
    try:
        found = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    own = found.where(F.col("tokenizer") == version)
    return own.groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, cache: str | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``cache`` is the Parquet folder of stored counts, which a later call finds again; without one, a new folder in the
    shared directory is filled. Counts appended twice (a retry, two jobs at once) count once. The content is normalised
    only where that leaves the count alone: a null text counts as the empty one (0 tokens). Repeated rows and texts share
    one cache entry and each return a row, null ids too; extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    cache = cache or new_table_path(spark, "token-cache")
    version = tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    known = stored_counts(spark, cache, version)
    missing = keyed if known is None else keyed.join(known.select("digest"), "digest", "left_anti")
    distinct = missing.groupBy("digest").agg(F.first("text").alias("text"))
    _encode(distinct, tokenizer_path, version).write.mode("append").parquet(cache)
    stored = stored_counts(spark, cache, version)
    return keyed.select("doc_id", "digest").join(stored, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
