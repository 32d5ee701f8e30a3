"""Reversible line dedup: sharded cuckoo filters over exact reference counts (operator 7).

The counts table tells for each line key in how many documents it stands; documents are added with +1 and removed with
-1. A cuckoo filter per shard holds the keys that reach the threshold: keys enter and leave it as their count crosses
the threshold, without a rebuild. A document's keys are sent to their shard, where the filter rules out almost all of
them, and what is left is verified against the counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import map_batches, materialise, unused

#: Keys wanted in a shard's filter: bounds a task's memory at any size of the corpus.
SHARD_KEYS = 1 << 16
#: Parts of a shard's probes, so that a line with a third of all rows is probed in many tasks.
SALTS = 64

_SLOTS = 4


class CuckooFilter:
    """Buckets of four 16-bit tags; a key may stand in either of two buckets. Digests have 16 bytes."""

    def __init__(self, buckets: int, table: np.ndarray | None = None) -> None:
        self.buckets = buckets
        self.table = np.zeros((buckets, _SLOTS), np.uint16) if table is None else table

    @classmethod
    def of(cls, digests: np.ndarray) -> CuckooFilter:
        """A filter with all ``digests`` ((n, 16) bytes), at most four fifths full."""
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, len(digests)) / _SLOTS / 0.8))))
        while True:
            made = cls(buckets)
            if all(made.insert(d) for d in made._fill(digests)):
                return made
            buckets *= 2

    def _fill(self, digests: np.ndarray) -> np.ndarray:
        """Put digests into an empty filter's free slots, all at once; returns those whose two buckets are full."""
        tags, one = self._tags(digests), self._first(digests)
        used, left = np.zeros(self.buckets, np.int64), np.arange(len(digests))
        for buckets in (one, self._other(one, tags)):
            order = left[np.argsort(buckets[left], kind="stable")]
            own = buckets[order]
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
            slot = used[own] + np.arange(len(own)) - np.repeat(starts, np.diff([*starts, len(own)]))
            fits = slot < _SLOTS
            self.table[own[fits], slot[fits]] = tags[order[fits]]
            used += np.bincount(own[fits], minlength=self.buckets)
            left = order[~fits]
        return digests[left]

    def _tags(self, digests: np.ndarray) -> np.ndarray:
        tags = digests[:, 8:10].copy().view("<u2").ravel()
        return np.where(tags == 0, 1, tags).astype(np.uint16)

    def _first(self, digests: np.ndarray) -> np.ndarray:
        return (digests[:, 0:7].astype(np.uint64) @ (np.uint64(256) ** np.arange(7, dtype=np.uint64)) % np.uint64(self.buckets)).astype(np.int64)

    def _other(self, bucket, tag):
        return bucket ^ (tag.astype(np.int64) * 0x5BD1E995 & (self.buckets - 1))

    def _places(self, digest: np.ndarray):
        rows = np.frombuffer(bytes(digest), np.uint8).reshape(1, 16)
        tag, one = self._tags(rows), self._first(rows)
        return tag[0], int(one[0]), int(self._other(one, tag)[0])

    def insert(self, digest: np.ndarray) -> bool:
        tag, one, two = self._places(digest)
        for bucket in (one, two):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = tag
                return True
        bucket, moves = two, []
        for kick in range(500):
            slot = kick % _SLOTS
            moves.append((bucket, slot, self.table[bucket, slot]))
            tag, self.table[bucket, slot] = self.table[bucket, slot], tag
            bucket = int(self._other(np.array([bucket]), np.array([tag]))[0])
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = tag
                return True
        for bucket, slot, was in reversed(moves):  # full: leave all as it was, for the caller to make a larger one
            self.table[bucket, slot] = was
        return False

    def delete(self, digest: np.ndarray) -> bool:
        tag, one, two = self._places(digest)
        for bucket in (one, two):
            held = np.flatnonzero(self.table[bucket] == tag)
            if len(held):
                self.table[bucket, held[0]] = 0
                return True
        return False

    def contains(self, digests: np.ndarray) -> np.ndarray:
        tags, one = self._tags(digests), self._first(digests)
        two = self._other(one, tags)
        return ((self.table[one] == tags[:, None]) | (self.table[two] == tags[:, None])).any(axis=1)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, np.uint16).reshape(-1, _SLOTS).copy()
        return cls(len(table), table)


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip().lower()


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def document_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): the distinct non-empty line keys of each document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, digests = [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            keys = {line_key(x) for x in (text or b"").split(b"\n")} - {b""}
            ids += [doc_id] * len(keys)
            digests += map(_digest, keys)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary())], ["doc_id", "digest"])

    return map_batches(_text(docs), run, "doc_id long, digest binary")


def count_keys(keys: DataFrame) -> DataFrame:
    """The exact reference counts: (digest, n_docs)."""
    return keys.groupBy("digest").agg(F.count("*").alias("n_docs"))


def update_counts(counts: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """The counts after the documents with keys ``added`` come and those with keys ``removed`` go."""
    parts = counts
    if added is not None:
        parts = parts.unionByName(count_keys(added))
    if removed is not None:
        parts = parts.unionByName(count_keys(removed).withColumn("n_docs", -F.col("n_docs")))
    return parts.groupBy("digest").agg(F.sum("n_docs").alias("n_docs")).where("n_docs > 0")


def shards_for(n: int) -> int:
    """Shards for ``n`` frequent keys: a power of two."""
    return 1 << max(0, int(np.ceil(np.log2(max(1, n) / SHARD_KEYS))))


def _shard(shards: int) -> F.Column:
    """A key's shard: the last four bytes of its digest, which neither its bucket nor its tag reads."""
    return F.pmod(F.conv(F.hex(F.substring("digest", 13, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _rows(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 16)


def build_filters(counts: DataFrame, threshold: int, shards: int) -> DataFrame:
    """(shard, filter): a cuckoo filter of each shard's keys with ``threshold`` documents or more."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "filter": [CuckooFilter.of(_rows(group["digest"])).to_bytes()]})

    frequent = counts.where(F.col("n_docs") >= threshold).select(_shard(shards).alias("shard"), "digest")
    return frequent.groupBy("shard").applyInPandas(build, "shard int, filter binary")


def update_filters(filters: DataFrame, before: DataFrame, after: DataFrame, threshold: int, shards: int) -> DataFrame:
    """The filters after keys crossed the threshold between the counts ``before`` and ``after``; ``shards`` as built."""
    old, new = (c.where(F.col("n_docs") >= threshold).select("digest") for c in (before, after))
    change = old.join(new, "digest", "left_anti").withColumn("enters", F.lit(False)).unionByName(new.join(old, "digest", "left_anti").withColumn("enters", F.lit(True)))

    def apply(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        held = CuckooFilter.from_bytes(left["filter"].iloc[0]) if len(left) else CuckooFilter(4)
        for digest in _rows(right["digest"][~right["enters"].astype(bool)]):
            held.delete(digest)
        for digest in _rows(right["digest"][right["enters"].astype(bool)]):
            if not held.insert(digest):
                return pd.DataFrame({"shard": [key[0]], "filter": [None]})  # too full: the caller builds this shard anew
        return pd.DataFrame({"shard": [key[0]], "filter": [held.to_bytes()]})

    change = change.withColumn("shard", _shard(shards))
    updated = materialise(filters.groupBy("shard").cogroup(change.groupBy("shard")).applyInPandas(apply, "shard int, filter binary"), "filters")
    full = updated.where("filter is null").select("shard")
    again = build_filters(after.withColumn("s", _shard(shards)).join(full, F.col("s") == F.col("shard"), "left_semi").select("digest", "n_docs"), threshold, shards)
    return updated.where("filter is not null").unionByName(again)


def probe(keys: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The keys (doc_id, digest) that their shard's filter does not rule out.

    Keys and filters are dealt by (shard, salt) and each filter is sorted before its keys, so a task holds one filter and
    one batch of keys at a time, however many keys a shard has.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    asked = keys.select(_shard(shards).alias("shard"), part.alias("salt"), "doc_id", F.col("digest").alias("data"), F.lit(1).alias("order"))
    held = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(None).cast("long").alias("doc_id"), F.col("filter").alias("data"), F.lit(0).alias("order"))
    dealt = asked.unionByName(held).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = (-1, -1), None
        for batch in batches:
            shard, salt, order = (batch.column(c).to_numpy() for c in ("shard", "salt", "order"))
            edges = np.flatnonzero((shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1]) | (order[1:] == 0)) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(shard)], strict=True):
                if start == end:
                    continue
                if (shard[start], salt[start]) != at:
                    at, held = (shard[start], salt[start]), None
                if order[start] == 0:
                    held, start = CuckooFilter.from_bytes(batch.column("data")[start].as_py()), start + 1
                if held is not None and start < end:
                    own = batch.slice(start, end - start)
                    found = pa.array(held.contains(_rows(own.column("data").to_pylist())))
                    yield pa.RecordBatch.from_arrays([own.column("doc_id").filter(found), own.column("data").filter(found)], ["doc_id", "digest"])

    return dealt.select("shard", "salt", "order", "doc_id", "data").mapInArrow(run, "doc_id long, digest binary")


def _kept(text: bytes | None, dropped: set[bytes]) -> tuple[int, int, bytes]:
    lines = (text or b"").split(b"\n")
    if not dropped:
        return len(lines), 0, b"\n".join(lines)
    kept = [x for x in lines if not (k := line_key(x)) or _digest(k) not in dropped]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def _with_frequent_lines(docs: DataFrame, threshold: int, dropped: str) -> DataFrame:
    """The rows of ``docs`` with ``dropped``: the digests that the row's text loses (null: none).

    The join goes by a hash of doc_id and text, so a null or repeated doc_id is a row like any other; where two rows
    share a hash, each gets the frequent digests of both, and its own lines still decide.
    """
    key = unused([*docs.columns, dropped], "_key")
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    frequent = frequent_line_docs(keyed.select(F.col(key).alias("doc_id"), "text"), threshold)
    return keyed.join(frequent.select(F.col("doc_id").alias(key), F.col("dropped").alias(dropped)), key, "left").drop(key)


def frequent_line_docs(docs: DataFrame, threshold: int = 10) -> DataFrame:
    """(doc_id, dropped): the digests that each document loses, for documents that lose any."""
    keys = materialise(document_keys(docs), "line-keys")
    counts = materialise(count_keys(keys), "line-counts")
    frequent = materialise(counts.where(F.col("n_docs") >= threshold), "frequent-lines")
    shards = shards_for(frequent.count())
    filters = materialise(build_filters(frequent, threshold, shards), "line-filters")
    hits = probe(keys, filters, shards).join(frequent.select("digest"), "digest")
    return hits.groupBy("doc_id").agg(F.collect_set("digest").alias("dropped"))  # at most a document's lines


def dedup_lines(docs: DataFrame, threshold: int = 10, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_lines (before), n_dropped, kept_sha256 (and the kept text where ``with_text``).

    Lines whose key has at least one character and stands in ``threshold`` documents or more go, everywhere. A null or
    empty text is one empty line and stays. Every row counts as a document, whether its doc_id is null or repeated; extra
    columns are ignored; an empty table gives an empty result.
    """
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", text string" * with_text

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [_kept(t, set(d or ())) for t, d in zip(batch.column("text").to_pylist(), batch.column("_dropped").to_pylist(), strict=True)]
        columns = [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())]
        names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
        if with_text:
            texts = [None if t is None else r[2].decode() for t, r in zip(batch.column("text").to_pylist(), rows, strict=True)]
            columns, names = [*columns, pa.array(texts, pa.string())], [*names, "text"]
        return pa.RecordBatch.from_arrays(columns, names)

    return map_batches(_with_frequent_lines(_text(docs), threshold, "_dropped"), run, schema)


def without_frequent_lines(docs: DataFrame, threshold: int = 10) -> DataFrame:
    """The rows of ``docs``, each once and with all its columns, the text as ``dedup_lines`` keeps it."""
    names, dropped = docs.columns, unused(docs.columns, "_dropped")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = zip(batch.column("text").to_pylist(), batch.column(dropped).to_pylist(), strict=True)
        texts = pa.array([None if t is None else _kept(t, set(d or ()))[2].decode() for t, d in pairs], pa.string())
        return pa.RecordBatch.from_arrays([texts if c == "text" else batch.column(c) for c in names], names)

    rows = _with_frequent_lines(docs, threshold, dropped).withColumn("text", F.col("text").cast("string").cast("binary"))
    return map_batches(rows, run, docs.withColumn("text", F.col("text").cast("string")).schema)
