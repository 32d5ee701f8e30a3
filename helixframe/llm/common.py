"""Helpers shared by the operators: shared-folder materialisation and word patterns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space of all word and line definitions (\x20, \x09-\x0D).
SPACE = "\\x20\\x09-\\x0D"

#: Rows of one Arrow batch: bounds a Python worker's memory on long texts.
BATCH_ROWS = 1024

#: Row numbers (8 bytes each) that are broadcast at most.
BROADCAST_KEYS = 1_000_000

#: Column of ``numbered``.
ROW = "_row"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a folder of our own, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.getCheckpointDir():
            if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="helixframe-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(names: list[str], base: str) -> str:
    """``base``, with as many underscores after it as make it none of ``names``."""
    taken = {n.lower() for n in names}
    while base.lower() in taken:
        base += "_"
    return base


def numbered(df: DataFrame, name: str, row: str = ROW) -> DataFrame:
    """``df``, written, with a number of each row in ``row``: rows that agree in all columns stay apart."""
    return materialise(df.withColumn(row, F.monotonically_increasing_id()), name)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is not in ``gone``: keys go to all tasks up to BROADCAST_KEYS, rows are shuffled beyond it."""
    gone = materialise(gone.select(key).distinct(), "gone")
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, key, "left_anti")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, rows: int = BATCH_ROWS) -> DataFrame:
    """Apply ``fn`` to each Arrow batch of ``df`` (at most ``rows`` rows each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield fn(batch.slice(start, rows))

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


_KEPT: dict[Hashable, Any] = {}


def kept_in_worker(key: Hashable, make: Callable[[], Any]) -> Any:
    """``make()``, made once in a Python worker and kept between its tasks until another key is asked for.

    Workers outlive the operators: what one learned goes, and its memory back to the system, when the next one begins.
    """
    if key not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
                trim(0)
        _KEPT[key] = make()
    return _KEPT[key]


def words_column(text: Column, lower: bool = False) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of ``text`` (null: empty array); ``lower`` maps A-Z to a-z."""
    text = F.coalesce(text, F.lit(""))
    if lower:
        text = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that later filters do not compute again: the optimizer moves no filter below an outer explode."""
    return df.withColumn(name, F.explode_outer(F.array(value)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
