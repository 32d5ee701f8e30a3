"""Readers and writers of sequence files."""

from __future__ import annotations

import struct

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from helixframe.functions.sequence import detect_type, sanitize
from helixframe.operators.quality import mott_interval
from helixframe.operators.storage import materialise


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(name, description, sequence, seq_type): a row for each record; large files are split between tasks.

    Text before the first ``>`` and records without a sequence are dropped; line ends and white space at them go.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def without_preambles(batches):
        """A file's first row is a record only if it starts with the mark; rows come in the file's order."""
        last = None
        for batch in batches:
            keep = []
            for value, file, block in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block")), strict=True):
                keep.append(block > 0 or file == last or value.lstrip("\ufeff").startswith(">"))
                last = file if block == 0 else last
            yield pa.RecordBatch.from_arrays([batch.column("value").filter(pa.array(keep, pa.bool_()))], ["value"])

    raw = raw.mapInArrow(without_preambles, "value string").select(F.regexp_replace("value", "[\r\ufeff]", "").alias("value"))
    first = F.col("value").startswith(">")
    inner = F.when(first, F.substring(F.col("value"), F.lit(2), F.length("value"))).otherwise(F.col("value"))
    records = raw.select(inner.alias("value"))
    header = F.trim(F.split_part("value", F.lit("\n"), F.lit(1)))
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    named = records.select(F.regexp_extract(header, r"^(\S*)", 1).alias("name"), F.trim(F.regexp_replace(header, r"^\S*", "")).alias("description"), F.upper(body).alias("sequence"))
    return named.where("sequence <> ''").select("*", detect_type(F.col("sequence")).alias("seq_type"))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, n, value): the lines of each file that are not blank, numbered from 0 in its order.

    Files are split between tasks: each split counts its lines, and the sums of those before it are added.
    """
    lines = spark.read.text(path).where(F.trim(F.regexp_replace("value", "\r", "")) != "")
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("value"))
    lines = materialise(lines, "lines")
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(blocks.select("file", "block", "first", before.alias("before")), ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first")).alias("n"), "value")


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, idx, name, description, sequence, quality_scores): a row for each four lines of a file, of any size.

    Blank lines go first; a record without ``@`` is skipped; qualities stay only where they are as long as the bases.
    """
    part = lambda k: F.max(F.when(F.col("n") % 4 == k, F.col("value"))).alias(f"line{k}")
    rows = numbered_lines(spark, path).groupBy("file", F.floor(F.col("n") / 4).cast("int").alias("idx")).agg(*map(part, range(4)))
    return fastq_fields(rows)


def fastq_fields(rows: DataFrame) -> DataFrame:
    """The records of (file, idx, line0 to line3): those whose first line begins with ``@`` and that have a fourth."""
    rows = rows.where(F.col("line0").startswith("@") & F.col("line3").isNotNull())
    header = F.substring(F.col("line0"), F.lit(2), F.length("line0"))
    name = F.regexp_extract(header, r"^(\S*)", 1)
    sequence, signs = F.upper(F.trim("line1")), F.trim("line3")
    quality = F.transform(F.split(signs, ""), lambda c: F.ascii(c) - 33)
    return rows.select("file", "idx", F.when(name == "", F.concat(F.lit("read_"), F.col("idx").cast("string"))).otherwise(name).alias("name"), F.trim(F.regexp_replace(header, r"^\S*", "")).alias("description"), sequence.alias("sequence"), F.when(F.length(signs) == F.length(sequence), quality).alias("quality_scores"))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, sequence, seq_type, quality_scores) of FASTA and FASTQ files, told apart by their first sign.

    A file that begins as FASTQ but holds no whole record is read as FASTA.
    """
    first = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("id"), F.trim("value").startswith("@").alias("reads"), F.col("_metadata.file_block_start").alias("block"))
    kinds = {r["file"]: r["reads"] for r in first.groupBy("file").agg(F.min_by("reads", F.struct("block", "id")).alias("reads")).collect()}  # a row for each file, which the driver lists anyway
    names = ["name", "description", "sequence", "seq_type", "quality_scores"]
    empty = spark.createDataFrame([], "name string, description string, sequence string, seq_type string, quality_scores array<int>")
    reads, records = ([f for f, kind in kinds.items() if kind == want] for want in (True, False))
    out = []
    if reads:
        found = read_fastq(spark, reads)
        out.append(found.withColumn("seq_type", detect_type(F.col("sequence"))).select(names))
        whole = {r["file"] for r in found.select("file").distinct().collect()}  # again a row for each file at most
        records += [f for f in reads if f not in whole]
    out += [read_fasta(spark, records).withColumn("quality_scores", F.lit(None).cast("array<int>")).select(names)] if records else []
    for frame in out:
        empty = empty.unionByName(frame)
    return empty


def barcode_sheet(spark: SparkSession, path: str) -> DataFrame:
    """(idx, sample, barcode) of a file of lines ``name,barcode``; barcodes in upper case, lines without both are skipped."""
    parts = F.split("value", ",")
    rows = numbered_lines(spark, path).select(F.col("n").cast("int").alias("idx"), F.trim(F.get(parts, F.lit(0))).alias("sample"), F.upper(F.trim(F.get(parts, F.lit(1)))).alias("barcode"))
    return rows.where("sample <> '' AND barcode <> ''")


def _all_digits(parts: Column) -> Column:
    return F.forall(parts, lambda x: x.rlike("^[0-9]+$"))


def _illumina_name(name: Column, comment: Column) -> Column:
    """instrument:run:flowcell:lane:tile:x:y and, after a blank, read:filtered:control:index."""
    place, read = F.split(name, ":"), F.split(comment, ":")
    numbers = F.array(F.get(place, F.lit(1)), *(F.get(place, F.lit(k)) for k in range(3, 7)))
    said = F.array(F.get(read, F.lit(0)), F.get(read, F.lit(2)))
    return (F.size(place) == 7) & _all_digits(numbers) & (F.size(read) >= 3) & F.get(read, F.lit(1)).isin("Y", "N") & _all_digits(said)


def _nanopore_fields(comment: Column) -> Column:
    """key=value fields, with runid and one of ch and read among the keys."""
    keys = F.transform(F.split(comment, r"\s+"), lambda x: F.when(F.contains(x, F.lit("=")), F.split_part(x, F.lit("="), F.lit(1))))
    return F.array_contains(keys, "runid") & F.arrays_overlap(keys, F.array(F.lit("ch"), F.lit("read")))


def _pacbio_name(name: Column) -> Column:
    """movie/hole/start_end of a subread, or movie/hole/ccs of a consensus."""
    parts = F.split(name, "/")
    last = F.get(parts, F.lit(2))
    span = F.split(last, "_")
    return (F.size(parts) >= 3) & (F.get(parts, F.lit(0)) != "") & _all_digits(F.array(F.get(parts, F.lit(1)))) & ((last == "ccs") | ((F.size(span) == 2) & _all_digits(span)))


def platform(file: Column, preview: Column) -> Column:
    """sanger, illumina, nanopore, pacbio or unknown, from a file's name and the record headers of its first lines.

    Each of the first eight lines that begins a record (@ or >) is parted into its name and comment, which are held
    against the makers' published forms; FASTQ of no known form counts as illumina. Null: unknown.
    """
    lines = F.slice(F.split(F.coalesce(preview, F.lit("")), r"\r?\n"), 1, 8)
    headers = F.filter(lines, lambda x: x.startswith("@") | x.startswith(">"))
    name = lambda x: F.substring_index(F.substring(x, F.lit(2), F.length(x)), " ", 1)
    comment = lambda x: F.ltrim(F.substring(x, F.length(name(x)) + 2, F.length(x)))
    trace = F.lower(F.substring_index(F.coalesce(file, F.lit("")), ".", -1)).isin("ab1", "scf") & F.contains(F.coalesce(file, F.lit("")), F.lit("."))
    first = F.get(F.filter(lines, lambda x: F.trim(x) != ""), F.lit(0))
    kinds = {"sanger": trace | F.get(lines, F.lit(0)).startswith("ABIF"), "illumina": F.exists(headers, lambda x: x.startswith("@") & _illumina_name(name(x), comment(x))), "nanopore": F.exists(headers, lambda x: _nanopore_fields(comment(x))), "pacbio": F.exists(headers, lambda x: _pacbio_name(name(x)))}
    known = F.coalesce(*(F.when(is_kind, kind) for kind, is_kind in kinds.items()))
    return F.coalesce(known, F.when(F.ltrim(first).startswith("@"), "illumina"), F.lit("unknown"))


TRACE = StructType().add("bases", StringType()).add("quality_scores", ArrayType(IntegerType()))


def parse_trace(data: bytes) -> tuple[str | None, list[int] | None]:
    """Bases and qualities of an ABIF trace: of each tag the entry with the highest number; null where it is none."""
    if data[:4] != b"ABIF" or len(data) < 34:
        return None, None
    count, place = struct.unpack_from(">i", data, 18)[0], struct.unpack_from(">i", data, 26)[0]
    found: dict[bytes, tuple[int, bytes]] = {}
    for k in range(count):
        at = place + 28 * k
        if at + 28 > len(data):
            break
        tag, number, size = data[at : at + 4], *struct.unpack_from(">i", data, at + 4), struct.unpack_from(">i", data, at + 16)[0]
        start = at + 20 if size <= 4 else struct.unpack_from(">i", data, at + 20)[0]
        if tag in (b"PBAS", b"PCON") and number >= found.get(tag, (-1,))[0]:
            found[tag] = number, data[start : start + size]
    bases = found[b"PBAS"][1].decode("latin-1") if b"PBAS" in found else None
    return bases, list(found[b"PCON"][1]) if b"PCON" in found else None


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """(path, bases, quality_scores) of ABIF files; null fields where a file is none."""

    @F.pandas_udf(TRACE)
    def parse(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_trace(c) for c in content], columns=TRACE.names)

    return spark.read.format("binaryFile").load(path).select("path", parse("content").alias("t")).select("path", "t.*")


def sanger_reads(traces: DataFrame) -> DataFrame:
    """(path, sequence, quality_scores) of (path, bases, quality_scores): trimmed to the best stretch at Q20, sanitized;
    qualities go where that changes the length. Files without bases are left out."""
    cut = traces.where("bases is not null").withColumn("m", F.when(F.size("quality_scores") > 0, mott_interval(F.col("quality_scores"))))
    start, end = F.coalesce(F.col("m.start"), F.lit(0)), F.coalesce(F.col("m.end"), F.length("bases"))
    cut = cut.select("path", F.substring(F.col("bases"), start + 1, end - start).alias("raw"), F.slice("quality_scores", start + 1, end - start).alias("q")).withColumn("sequence", sanitize(F.col("raw")))
    return cut.select("path", "sequence", F.when(F.length("sequence") == F.size("q"), F.col("q")).alias("quality_scores"))


def fasta_text(records: DataFrame) -> DataFrame:
    """One column ``value`` for ``write.text``: a FASTA record of each (name, description, sequence)."""
    return records.select(F.concat(F.lit(">"), F.concat_ws(" ", "name", F.when(F.col("description") != "", F.col("description"))), F.lit("\n"), "sequence").alias("value"))


def fastq_text(reads: DataFrame) -> DataFrame:
    """One column ``value``: a FASTQ record of each (name, sequence, quality_scores)."""
    quality = F.array_join(F.transform("quality_scores", lambda q: F.char(q + 33)), "")
    return reads.select(F.concat(F.lit("@"), "name", F.lit("\n"), "sequence", F.lit("\n+\n"), quality).alias("value"))


def report_text(table: DataFrame, title: str, order: str) -> DataFrame:
    """(line, value): a table as aligned text, columns as wide as their longest value and two blanks, between rules of 70
    signs; rows by ``order``. The widths are one summary row; lines are numbered within the table's own sort."""
    names = table.columns
    text = table.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names), F.col(order).alias("_order"))
    widths = text.agg(*(F.coalesce(F.max(F.length(c)), F.lit(0)).alias(c) for c in names)).first()
    wide = {c: max(widths[c], len(c)) + 2 for c in names}
    head = ["=" * 70, title.upper(), "=" * 70, "".join(c.ljust(wide[c]) for c in names), "-" * sum(wide.values())]
    rows = text.select((F.row_number().over(Window.orderBy("_order")) + len(head) - 1).cast("int").alias("line"), F.concat(*(F.rpad(c, wide[c], " ") for c in names)).alias("value"))
    return table.sparkSession.createDataFrame(list(enumerate(head)), "line int, value string").unionByName(rows)
