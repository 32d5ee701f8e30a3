"""Quality classifier on supervised subword embeddings (operator 1).

Each word has a vector hashed from the word itself, and one for each of its character n-grams; so have pairs of
neighbouring words. A document is the mean of all of them, and a softmax layer tells its quality. Vectors and layer are
learned together by stochastic gradient descent in numpy, on a bounded sample of labelled documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import kept_in_worker, map_batches


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 15
    width: int = 16
    shortest: int = 3
    longest: int = 5
    epochs: int = 8
    rate: float = 4.0
    batch: int = 8
    #: Word vectors learn so many times faster than the layer: a single vector's share of a document is small.
    spread: float = 100.0
    #: Labelled documents to fit on, at most: those with the lowest hash of their id. Bounds the driver's work.
    sample: int = 3000
    seed: int = 7
    threshold: float = 0.3


@dataclass(frozen=True, eq=False)
class Model:
    settings: Settings
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


def word_features(word: str, s: Settings) -> list[int]:
    """Buckets of a word and of its character n-grams, the ends of the word marked."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in range(s.shortest, s.longest + 1) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(x.encode()) % s.buckets for x in ["w" + word, *grams]]


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def many_features(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(``word_features`` of each of ``words``, one after another, and their numbers): the n-grams at all places are hashed
    together, a character and in it a byte at a time."""
    own = np.frombuffer(("<" + "><".join(words) + ">").encode(), np.uint8)
    letters = np.flatnonzero((own & 0xC0) != 0x80)
    width = np.diff(np.append(letters, len(own)))
    lengths = np.array([len(w) for w in words]) + 2
    word, starts = np.repeat(np.arange(len(words)), lengths), np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - starts[word]
    left, sizes = lengths[word] - place, 1 + sum(np.maximum(lengths - n + 1, 0) for n in range(s.shortest, s.longest + 1))
    at = np.cumsum(sizes) - sizes
    flat, crc = np.empty(sizes.sum(), np.uint32), np.full(len(letters), 0xFFFFFFFF, np.uint32)
    flat[at] = [zlib.crc32(b"w" + w.encode()) for w in words]
    at = at + 1
    for n in range(1, s.longest + 1):
        crc = crc[: len(letters) - n + 1]
        crc = _CRC[(crc ^ own[letters[n - 1 :]]) & 255] ^ (crc >> 8)
        for k in range(1, width.max()):
            more = np.flatnonzero(width[n - 1 :] > k)
            crc[more] = _CRC[(crc[more] ^ own[letters[more + n - 1] + k]) & 255] ^ (crc[more] >> 8)
        if n >= s.shortest:
            whole = np.flatnonzero(left[: len(crc)] >= n)
            flat[at[word[whole]] + place[whole]] = ~crc[whole]
            at = at + np.maximum(lengths - n + 1, 0)
    return (flat % np.uint32(s.buckets)).astype(np.int64), sizes


def document_words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _pairs(ids: np.ndarray, s: Settings) -> np.ndarray:
    """Buckets of neighbouring words, from the words' own hashes; a word after itself is one feature for all words."""
    mixed = ((ids[:-1].astype(np.uint64) * np.uint64(0x9E3779B1) + ids[1:].astype(np.uint64) * np.uint64(0x85EBCA77)) >> np.uint64(7)) % np.uint64(s.buckets)
    return np.where(ids[:-1] == ids[1:], np.uint64(0), mixed)


def document_features(text: str | None, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of a document: its mean vector is shares @ vectors[buckets]."""
    words = document_words(text)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    names, counts = np.unique(np.array(words, object), return_counts=True)
    own = [word_features(w, s) for w in names]
    ids = np.array([zlib.crc32(w.encode()) for w in words], np.uint64)
    pairs = _pairs(ids, s).astype(np.int64)
    flat = np.concatenate([np.concatenate([np.array(f, np.int64) for f in own]), pairs])
    weight = np.concatenate([np.repeat(counts, [len(f) for f in own]), np.ones(len(pairs), np.int64)])
    total = np.bincount(flat, weights=weight, minlength=s.buckets)
    used = np.flatnonzero(total)
    return used, (total[used] / total.sum()).astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: list[int], s: Settings) -> Model:
    """Softmax over the mean vector, by minibatch gradient descent with a linearly falling rate."""
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.width, 1 / s.width, (s.buckets, s.width)).astype(np.float32)
    weights, bias = np.zeros((s.width, 2), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, s.epochs * ((len(labels) + s.batch - 1) // s.batch)), 0
    for _ in range(s.epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), s.batch):
            own = order[at : at + s.batch]
            rate = s.rate * (1 - done / steps) / len(own)
            done += 1
            means = np.stack([features[i][1] @ vectors[features[i][0]] for i in own])
            error = _softmax(means @ weights + bias)
            error[np.arange(len(own)), [labels[i] for i in own]] -= 1
            back = error @ weights.T
            weights = np.clip(weights - rate * (means.T @ error), -20, 20)
            bias -= rate * 0.1 * error.sum(axis=0)
            for i, g in zip(own, back, strict=True):
                buckets, shares = features[i]
                step = min(s.spread, 0.1 / float(shares @ shares)) if len(shares) else 0.0  # no leap on texts of few features
                vectors[buckets] -= rate * step * np.outer(shares, np.clip(g, -1, 1))
    return Model(s, vectors, weights, bias)


class WordTable:
    """What a model knows of the words met so far: a row each with the sum of its vectors, their number and its hash.

    Bounded: beyond ROWS words it starts anew, with the same results.
    """

    ROWS = 500_000
    #: New words that are hashed together.
    TOGETHER = 4096
    #: Words of the texts that are looked up together.
    GROUP = 30_000

    def __init__(self, model: Model) -> None:
        self.model, self.rows = model, {}
        self.sums = np.zeros((self.ROWS, model.settings.width), np.float32)
        self.sizes = np.zeros(self.ROWS, np.int32)
        self.hashes = np.zeros(self.ROWS, np.uint64)

    def find(self, words: list[str]) -> np.ndarray:
        found = list(map(self.rows.get, words))
        if None in found:
            new = {w for w, row in zip(words, found, strict=True) if row is None}
            if len(self.rows) + len(new) > self.ROWS:
                self.rows.clear()
                new = set(words)
            new = list(new)
            for at in range(0, len(new), self.TOGETHER):
                self._learn(new[at : at + self.TOGETHER])
            found = [self.rows[w] for w in words]
        return np.array(found)

    def _learn(self, words: list[str]) -> None:
        (features, sizes), first, end = many_features(words, self.model.settings), len(self.rows), len(self.rows) + len(words)
        vectors, ends = self.model.vectors[features], np.cumsum(sizes).tolist()
        self.sums[first:end] = [vectors[a:b].sum(axis=0) for a, b in zip([0, *ends], ends, strict=False)]
        self.sizes[first:end], self.hashes[first:end] = sizes, [zlib.crc32(w.encode()) for w in words]
        self.rows.update(zip(words, range(first, end), strict=True))


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[list[str]]]]:
    """(number of the first, words of each) of texts one after another, of GROUP words at most or one alone."""
    group, first, held = [], 0, 0
    for k, text in enumerate(texts):
        words = document_words(text)
        if group and held + len(words) > min(WordTable.GROUP, WordTable.ROWS // 2):
            yield first, group
            group, first, held = [], k, 0
        group.append(words)
        held += len(words)
    if group:
        yield first, group


def score(texts: list[str | None], model: Model) -> np.ndarray:
    """Probability of quality 1; a text without words gets that of the bias alone."""
    s = model.settings
    table = kept_in_worker(model, lambda: WordTable(model))
    means = np.zeros((len(texts), s.width), np.float32)
    for first, group in _groups(texts):
        found = table.find([w for words in group for w in words]) if len(group) > 1 else None
        ends = np.cumsum([len(words) for words in group])
        for k, words in enumerate(group):
            total, size = np.zeros(s.width, np.float64), 0
            for at in range(0, len(words), WordTable.ROWS // 2):  # a very long text in parts, each with the last word before it
                rows = table.find(words[max(0, at - 1) : at + WordTable.ROWS // 2]) if found is None else found[ends[k] - len(words) : ends[k]]
                pairs = _pairs(table.hashes[rows], s).astype(np.int64)
                rows = rows[1:] if at else rows
                total += table.sums[rows].sum(axis=0) + model.vectors[pairs].sum(axis=0)
                size += int(table.sizes[rows].sum()) + len(pairs)
            if size:
                means[first + k] = total / size
    return _softmax(means @ model.weights + model.bias)[:, 1].astype(np.float64)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:  # noqa: B008
    """Fit on at most ``s.sample`` labelled documents outside the held-out fifth; features are made on the executors."""
    known = labels.where("quality is not null and doc_id is not null").where(~held_out())
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)
    sample = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [document_features(t, s) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("quality").cast(pa.int32()), pa.array([f[0].astype(np.uint16).tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary())],
            ["doc_id", "quality", "buckets", "shares"],
        )

    rows = sorted(map_batches(sample.select("doc_id", "quality", "text"), run, "doc_id long, quality int, buckets binary, shares binary").collect())
    features = [(np.frombuffer(r["buckets"], np.uint16).astype(np.int64), np.frombuffer(r["shares"], np.float32)) for r in rows]
    return train(features, [int(r["quality"] == 1) for r in rows], s)


def accepted(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """The rows of ``docs``, with all their columns, whose own text ``classify`` predicts as 1, whatever their doc_id."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, s))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(score(batch.column("text").cast(pa.string()).to_pylist(), model.value) >= s.threshold))

    return map_batches(docs, run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), with_text: bool = False) -> DataFrame:  # noqa: B008
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= the threshold).

    Labels with null fields are left out; two labels of one id count as the better one, and of several rows of a labelled
    id the text that sorts first is learned. A null doc_id is scored like any other. A null or empty text gets the
    score of the bias. Without labels every score is one half. Repeated rows each return a row; extra columns are
    ignored; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, s))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = score(batch.column("text").to_pylist(), model.value)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(scores), pa.array((scores >= s.threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
        )

    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")
