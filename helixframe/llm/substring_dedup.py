"""Substring dedup by an FM-index per shard (operator 9).

A repeated window of words is found by backward search in a shard's index. So that a window meets all its equals in one
shard, documents are cut into fragments: runs of windows that share their minimizer, the least hash among the short
word runs in a window. Equal windows have equal minimizers, and a fragment goes to its minimizer's shard. Only
minimizers found in more than one document are dealt, equal fragments are merged before, and a minimizer with too many
different fragments is dealt window by window. A shard indexes its fragments, streams them through the index, and
reports for each window the smallest document that holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import map_batches, materialise
from helixframe.llm.fm_index import FMIndex

#: Words whose least hash picks a window's shard.
GRAM = 8
#: Windows of a fragment at most; longer runs of one minimizer (periodic texts) are cut.
RUN = 64
#: Words wanted in a shard's index: bounds a task's memory.
SHARD_WORDS = 400_000
#: A minimizer with more different fragments than this (some 3.5 shards) is dealt by whole windows.
HOT_FRAGMENTS = 20_000
#: Hot minimizers up to this many are broadcast; more are joined by a shuffle.
BROADCAST_HOT = 1_000_000
#: Repeated minimizers up to this many go to all tasks (8 bytes each); more are joined by a shuffle, with equal results.
BROADCAST_MINIMIZERS = 4_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words; forgets what it has beyond a bound."""

    MOST = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


_HASHES = WordHashes()


def minimizers(words: list[bytes], window: int) -> np.ndarray:
    """For each window of ``words`` the least mixed hash of its GRAM-word runs, signed."""
    if len(words) < window:
        return np.zeros(0, np.int64)
    gram = min(GRAM, window)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = len(h) - gram + 1
    run = np.zeros(n, np.uint64)
    for k in range(gram):
        run = run * _MIX + h[k : k + n]
    run ^= run >> np.uint64(29)
    run *= np.uint64(0xBF58476D1CE4E5B9)
    run ^= run >> np.uint64(32)
    width, have = window - gram + 1, 1
    while have * 2 <= width:
        run = np.minimum(run[:-have], run[have:])
        have *= 2
    if rest := width - have:
        run = np.minimum(run[:-rest], run[rest:])
    return run.view(np.int64)


def runs(values: np.ndarray, most: int = RUN) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal values, none longer than ``most``."""
    edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)] if len(values) else [0]
    return [(a, min(a + most, end)) for start, end in zip(edges[:-1], edges[1:], strict=True) for a in range(start, end, most)]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text"))


def _repeated(docs: DataFrame, window: int) -> DataFrame:
    """(m): minimizers that stand in documents of different ids."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, found = [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = np.unique(minimizers((text or b"").split(), window))
            found.append(own)
            ids.append(np.full(len(own), doc_id, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found])), pa.array(np.concatenate([np.zeros(0, np.int64), *ids]))], ["m", "doc_id"])

    pairs = map_batches(docs.select("doc_id", "text"), run, "m long, doc_id long")
    return pairs.groupBy("m").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("m")


def _fragments(docs: DataFrame, repeated: DataFrame, window: int) -> DataFrame:
    """(m, digest, doc_id, text_key, start, words): fragments of the ``repeated`` minimizers."""
    spark = docs.sparkSession
    small = repeated.count() <= BROADCAST_MINIMIZERS
    known = None
    if small:
        known = spark.sparkContext.broadcast(np.sort(repeated.toPandas()["m"].to_numpy(np.int64)))
        docs = docs.withColumn("known", F.lit(None).cast("array<long>"))
    else:
        def pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(d, k, int(m)) for d, k, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text")), strict=True) for m in np.unique(minimizers((t or b"").split(), window))]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["doc_id", "text_key", "m"])

        own = map_batches(docs, pairs, "doc_id long, text_key long, m long").join(repeated, "m").groupBy("doc_id", "text_key").agg(F.collect_set("m").alias("known"))
        docs = docs.join(own, ["doc_id", "text_key"])
    schema = pa.schema([("m", pa.int64()), ("digest", pa.binary()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("words", pa.binary())])

    def fragments(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, key, text, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text", "known")), strict=True):
            words = (text or b"").split()
            values = minimizers(words, window)
            if not len(values):
                continue
            held = known.value if own is None else np.sort(np.array(own, np.int64))
            places = np.searchsorted(held, values)
            hit = held[np.minimum(places, len(held) - 1)] == values if len(held) else np.zeros(len(values), bool)
            if not hit.any():
                continue
            for a, b in runs(values):
                if hit[a]:
                    content = b" ".join(words[a : b + window - 1])
                    yield int(values[a]), hashlib.blake2b(content, digest_size=16).digest(), doc_id, key, a, content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = list(fragments(batch.slice(at, 64)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return docs.select("doc_id", "text_key", "text", "known").mapInArrow(run, "m long, digest binary, doc_id long, text_key long, start int, words binary")


def shard_matches(contents: list[bytes], docs: np.ndarray, window: int) -> list[list[int]]:
    """For each sequence of words the smallest of ``docs`` whose sequence holds the window, for each of its windows."""
    split = [c.split() for c in contents]
    names: dict[bytes, int] = {}
    ids = [[names.setdefault(w, len(names) + 1) for w in s] for s in split]
    lengths = np.array([len(s) for s in split], np.int64)
    text = np.array([x for s in ids for x in (*s, 0)], np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    index = FMIndex(text, len(names) + 1, window)
    owner = np.repeat(docs, lengths + 1)
    least = np.minimum.reduceat(owner[index.order], index.edges[:-1])
    classes = index.classes(text, begins, begins + lengths)
    return [least[classes[b : b + n - window + 1]].tolist() for b, n in zip(begins, lengths, strict=True)]


def _search(fragments: DataFrame, window: int) -> DataFrame:
    """(m, digest, least): for each window of the distinct fragments (m, digest, first_doc, words) its smallest document."""
    total = fragments.agg(F.coalesce(F.sum(F.length("words") / 6), F.lit(0))).first()[0]
    shards = max(12, int(total / SHARD_WORDS) + 1)

    def search(group: pd.DataFrame) -> pd.DataFrame:
        least = shard_matches(list(group["words"]), group["first_doc"].to_numpy(np.int64), window)
        return pd.DataFrame({"m": group["m"].to_numpy(), "digest": group["digest"].to_numpy(), "least": least})

    dealt = fragments.withColumn("shard", F.pmod(F.xxhash64("m"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(search, "m long, digest binary, least array<long>")


def _distinct(fragments: DataFrame) -> DataFrame:
    return fragments.groupBy("m", "digest").agg(F.min("doc_id").alias("first_doc"), F.first("words").alias("words"))


def _by_window(fragments: DataFrame, window: int) -> DataFrame:
    """Fragments cut into single windows, each dealt by its own digest."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, key, start, content in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "start", "words")), strict=True):
            words = content.split()
            for a in range(len(words) - window + 1):
                one = b" ".join(words[a : a + window])
                digest = hashlib.blake2b(one, digest_size=16).digest()
                rows.append((int.from_bytes(digest[:8], "little", signed=True), digest, doc_id, key, start + a, one))
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["m", "digest", "doc_id", "text_key", "start", "words"])

    return map_batches(fragments.select("doc_id", "text_key", "start", "words"), cut, "m long, digest binary, doc_id long, text_key long, start int, words binary", rows=64)


def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_key, starts): places of windows that also stand in a document of a smaller id."""
    repeated = materialise(_repeated(docs, window), "repeated-minimizers")
    fragments = materialise(_fragments(docs, repeated, window), "fragments")
    distinct = materialise(_distinct(fragments), "distinct-fragments")
    hot = materialise(distinct.groupBy("m").count().where(F.col("count") > HOT_FRAGMENTS).select("m"), "hot-minimizers")
    n_hot = hot.count()
    hot = F.broadcast(hot) if n_hot <= BROADCAST_HOT else hot
    found = _search(distinct.join(hot, "m", "left_anti"), window)
    places = [fragments.select("m", "digest", "doc_id", "text_key", "start").join(found, ["m", "digest"])]
    if n_hot:
        single = materialise(_by_window(fragments.join(hot, "m", "left_semi"), window), "fragment-windows")
        places.append(single.select("m", "digest", "doc_id", "text_key", "start").join(_search(_distinct(single), window), ["m", "digest"]))
    all_places = places[0] if len(places) == 1 else places[0].unionByName(places[1])
    own = F.filter(F.transform("least", lambda x, i: F.when(x < F.col("doc_id"), F.col("start") + i)), lambda x: x.isNotNull())
    starts = all_places.select("doc_id", "text_key", own.alias("starts")).where(F.size("starts") > 0)
    return starts.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("starts")).alias("starts"))  # at most a document's windows


def dedup_substrings(docs: DataFrame, window: int = 50, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (and the kept text where ``with_text``).

    Words covered by a window of ``window`` words that also stands in a document of a smaller id go; windows are judged
    on the input. A null text has no words; so has an empty one. Shorter texts keep all. Rows of equal id never count
    as smaller, so repeated rows all keep or lose the same; rows without an id lose nothing and count for none. Extra
    columns are ignored; an empty table gives an empty result. ``window`` may be 2 to 64.
    """
    keyed = _keyed(docs)
    starts = repeated_windows(keyed.where("doc_id is not null and text is not null"), window)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, own in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
            words = (text or b"").split()
            kept = words
            if own:
                edge = np.zeros(len(words) + 1, np.int64)
                places = np.unique(np.array(own, np.int64))
                np.add.at(edge, places, 1)
                np.add.at(edge, places + window, -1)
                kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            joined = b" ".join(kept)
            rows.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else ""))
        columns = [batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string())))]
        if with_text:
            columns.append(pa.array([r[3] for r in rows], pa.string()))
        return pa.RecordBatch.from_arrays(columns, schema.replace(",", "").split()[::2])

    return map_batches(keyed.join(starts, ["doc_id", "text_key"], "left").select("doc_id", "text", "starts"), run, schema)
