"""A store of documents by key: JSON lines in buckets, read by a schema, with lines that do not fit kept apart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.utils import AnalysisException

from helixframe.operators.storage import materialise

BUCKET, LINE, CORRUPT = "bucket", "value", "_corrupt"


@dataclass(frozen=True)
class Store:
    """Documents of ``schema`` below ``path``, one for each ``key``, in ``buckets`` folders by the key's hash.

    Lines are JSON objects. One that cannot be parsed, does not fit the schema or has no key is corrupt: ``read`` skips
    it, ``corrupt`` lists it, and an upsert that rewrites its folder moves it to ``<path>-quarantine`` first. ``buckets``
    must not change in a store's life. One writer at a time.
    """

    path: str
    schema: StructType
    key: str
    buckets: int = 64

    @property
    def quarantine_path(self) -> str:
        return self.path.rstrip("/") + "-quarantine"

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def lines(self, spark: SparkSession) -> DataFrame:
        """(value, bucket): the lines as they stand; none where the store has not been written yet."""
        schema = StructType().add(LINE, StringType()).add(BUCKET, IntegerType())
        try:
            return spark.read.schema(schema).text(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def parsed(self, lines: DataFrame) -> DataFrame:
        """``lines`` with ``doc``, null where the line is corrupt. Fields that the schema does not name are passed over."""
        wide = StructType(list(self.schema.fields)).add(CORRUPT, StringType())
        doc = F.from_json(LINE, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
        good = F.col(f"doc.{CORRUPT}").isNull() & F.col("doc")[self.key].isNotNull()
        own = F.struct(*(F.col("doc")[c].alias(c) for c in self.schema.names))
        return lines.withColumn("doc", doc).withColumn("doc", F.when(good, own))

    def read(self, spark: SparkSession) -> DataFrame:
        return self.parsed(self.lines(spark)).where("doc IS NOT NULL").select("doc.*")

    def corrupt(self, spark: SparkSession) -> DataFrame:
        """(value): corrupt lines in the store, not those in quarantine. Blank lines are none."""
        return self.parsed(self.lines(spark)).where(f"doc IS NULL AND trim({LINE}) <> ''").select(LINE)

    def quarantined(self, spark: SparkSession) -> DataFrame:
        """(value): the lines that upserts have moved out of the store; a repeated move of one line leaves it twice."""
        return Store(self.quarantine_path, self.schema, self.key, self.buckets).lines(spark).select(LINE)

    def upsert(self, rows: DataFrame, latest: str | None = None) -> list[int]:
        """Put ``rows`` in by key, new ones and replacements, and return the folders rewritten; others are not read.

        Of rows with one key the greatest by ``latest`` stays, ties by content; all rows beat what is stored. Rows without
        a key raise. The merged folders are written to the shared folder before the store is touched, so a lost executor
        costs a task, and corrupt lines are in quarantine before their folder goes.
        """
        spark = rows.sparkSession
        own = rows.select(*(F.col(c).cast(self.schema[c].dataType).alias(c) for c in self.schema.names))
        new = materialise(own.select(F.struct(*self.schema.names).alias("doc")).withColumn(BUCKET, self.bucket(F.col("doc")[self.key])), "store-new")
        if new.where(F.col("doc")[self.key].isNull()).limit(1).count():
            raise ValueError(f"rows without {self.key}")
        touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # at most as many as there are folders
        if not touched:
            return []
        old = self.parsed(self.lines(spark).where(F.col(BUCKET).isin(touched)))
        lost = old.where(f"doc IS NULL AND trim({LINE}) <> ''")
        lost.select(LINE, BUCKET).write.partitionBy(BUCKET).mode("append").text(self.quarantine_path)
        both = new.select("doc", BUCKET, F.lit(1).alias("new")).unionByName(old.where("doc IS NOT NULL").select("doc", BUCKET, F.lit(0).alias("new")))
        rank = F.struct("new", *([F.col("doc")[latest]] if latest else []), F.to_json("doc"))
        merged = both.groupBy(F.col("doc")[self.key].alias("k"), BUCKET).agg(F.max_by("doc", rank).alias("doc"))
        merged = materialise(merged.select(F.to_json("doc").alias(LINE), BUCKET), "store-merged")
        merged.repartition(BUCKET).write.partitionBy(BUCKET).mode("overwrite").option("partitionOverwriteMode", "dynamic").text(self.path)
        return touched

    def delete(self, spark: SparkSession, keys: DataFrame) -> list[int]:
        """Take out the documents of the column ``key`` of ``keys``; returns the folders rewritten. Corrupt lines stay."""
        gone = materialise(keys.select(F.col(self.key).cast(self.schema[self.key].dataType).alias("k")).where("k IS NOT NULL").distinct().withColumn(BUCKET, self.bucket(F.col("k"))), "store-gone")
        touched = sorted(r[0] for r in gone.select(BUCKET).distinct().collect())
        if touched:
            old = self.parsed(self.lines(spark).where(F.col(BUCKET).isin(touched))).withColumn("k", F.col("doc")[self.key])
            kept = materialise(old.join(gone.select("k"), "k", "left_anti").select(LINE, BUCKET), "store-kept")
            blank = spark.createDataFrame([("", b) for b in touched], f"{LINE} string, {BUCKET} int")  # a folder left without rows is emptied too
            kept.unionByName(blank).repartition(BUCKET).write.partitionBy(BUCKET).mode("overwrite").option("partitionOverwriteMode", "dynamic").text(self.path)
        return touched
