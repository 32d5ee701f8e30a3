"""Embedding near-duplicates by a pivot-permutation index (operator 13).

A vector is described by its PREFIX nearest reference points in order. Vectors that are close have nearly the same
points, so those of one label that share at least SHARED of them are candidates, and a candidate pair is a link where
its cosine, in doubles, reaches the threshold. Retrieval is by inverted lists of reference points: points are numbered
from the rarest, and a vector stands in the lists of its PREFIX - SHARED + 1 rarest, which every candidate pair has one
of in common. Equal vectors are one class; a list longer than BLOCK is cut into blocks, and each pair of blocks is a unit
of its own. A unit returns a row a class (links found, and the class that a spanning tree joins it to), never a row a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import BROADCAST_KEYS, map_batches, materialise
from helixframe.llm.simhash import _components, connected_components
from helixframe.llm.vectors import as_doubles, vectors

PREFIX, SHARED = 10, 3
#: Vectors of a list that one unit compares, and rows of them at a time.
BLOCK, STRIP = 2048, 256
#: A unit is a pair of blocks of one list; what a row brings to it.
KEYS, ROWS = ("label", "dim", "point", "first", "second"), ("id", "side", "copies", "cell", "signature")
#: Unit vectors and descriptions of a block.
Block = tuple[np.ndarray, np.ndarray]
#: 64-bit words that a description is folded to, to pass over pairs that cannot share enough points.
WORDS = 4
#: Reference points: some 64 vectors for each, within these bounds; chosen from a sample of SAMPLE vectors a point.
FEWEST, MOST, SAMPLE = 256, 4096, 4
#: Reference points taken from the data keep at least 60 degrees from each other, so a dense group has one of them.
APART = 0.5


def _keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
    labels, keys, cells = batch.column("label").to_pylist(), [], []
    for label, vector in zip(labels, vectors(batch.column("vector")), strict=True):
        if label is None or vector is None or not vector.any():
            keys.append(None)
            cells.append(None)
        else:
            cell = (vector + 0.0).astype("<f8")
            narrow = cell.astype("<f4")
            cells.append(narrow.tobytes() if (narrow == cell).all() else cell.tobytes())
            keys.append(hashlib.sha256(label.encode() + b"\0" + cell.tobytes()).digest())
    dims = pa.array([None if k is None else len(v) for k, v in zip(keys, batch.column("vector").to_pylist(), strict=True)], pa.int32())
    return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(keys, pa.binary()), dims, pa.array(cells, pa.binary())], ["vec_id", "label", "key", "dim", "cell"])


def unit(cell: bytes, dim: int) -> np.ndarray:
    """The vector of a cell at length one."""
    vector = np.frombuffer(cell, "<f4" if len(cell) == 4 * dim else "<f8").astype(np.float64)
    vector = vector / np.abs(vector).max()
    return vector / np.sqrt((vector * vector).sum())


def reference_points(sample: np.ndarray, dim: int, count: int) -> np.ndarray:
    """``count`` unit vectors: those of ``sample`` that keep apart, in its order, then random directions; rarest first.

    Rarity is how seldom a point is among the PREFIX nearest of the sample's vectors.
    """
    near, chosen = np.full(len(sample), -2.0), []
    for i in range(len(sample)):
        if len(chosen) < count and near[i] < APART:
            chosen.append(i)
            near = np.maximum(near, sample @ sample[i])
    rest = np.random.default_rng(dim).standard_normal((count - len(chosen), dim))
    points = np.concatenate([sample[chosen], rest / np.sqrt((rest * rest).sum(1, keepdims=True))])
    used = np.bincount(nearest_points(sample, points).ravel(), minlength=count)
    return points[np.argsort(used, kind="stable")]


def nearest_points(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The numbers of the PREFIX nearest points of each row, nearest first."""
    out = [np.argsort(-(rows[s : s + STRIP] @ points.T), axis=1, kind="stable")[:, :PREFIX] for s in range(0, len(rows), STRIP)]
    return np.concatenate(out).astype(np.int16) if out else np.zeros((0, PREFIX), np.int16)


def folded(signatures: np.ndarray) -> np.ndarray:
    """A bit for each point of a row, its number modulo 64 * WORDS: rows that share points share bits."""
    out, rows = np.zeros((len(signatures), WORDS), np.uint64), np.arange(len(signatures))
    for point in signatures.T.astype(np.uint64):
        at = (point // np.uint64(64)) % np.uint64(WORDS)
        out[rows, at] |= np.uint64(1) << point % np.uint64(64)
    return out


def compare(one: Block, other: Block | None, point: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): places of the links between the vectors of a list's block ``one`` and those of ``other`` (None: within it).

    A pair that also meets in the list of a smaller point is left to that one.
    """
    (xa, sa), (xb, sb) = one, one if other is None else other
    lists = PREFIX - SHARED + 1
    pa_, pb = (np.sort(s, axis=1)[:, :lists] for s in (sa, sb))
    fa, fb = folded(sa), folded(sb)
    lost = PREFIX - np.bitwise_count(fa).sum(axis=1, dtype=np.int16)  # points of a row that fall on one bit
    links: list[tuple[np.ndarray, np.ndarray]] = []
    for s in range(0, len(xa), STRIP):
        bits = sum(np.bitwise_count(fa[s : s + STRIP, None, w] & fb[None, :, w]) for w in range(WORDS))
        maybe = bits + lost[s : s + STRIP, None] >= SHARED
        if other is None:
            maybe &= np.arange(s, min(s + STRIP, len(xa)))[:, None] < np.arange(len(xb))[None, :]
        i, j = np.nonzero(maybe)
        if not len(i):
            continue
        shared = np.zeros(len(i), np.int8)
        for p in range(PREFIX):
            for q in range(PREFIX):
                shared += sa[s + i, p] == sb[j, q]
        enough = shared >= SHARED
        i, j = i[enough], j[enough]
        earlier = np.zeros(len(i), bool)
        for p in range(lists):
            for q in range(lists):
                earlier |= (pa_[s + i, p] == pb[j, q]) & (pb[j, q] < point)
        i, j = i[~earlier], j[~earlier]
        close = (xa[s : s + STRIP] @ xb.T)[i, j] >= threshold if len(i) else np.zeros(0, bool)
        links.append((s + i[close], j[close]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*links, strict=True)) if links else (none, none)


def _unit_links(threshold: float):
    """Batches of rows sorted by unit to a row for each class that links in its unit; one unit is held at a time."""

    def links_of(rows: dict[str, list], within: bool, point: int, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, copies, side = (np.array(rows[c], np.int64) for c in ("id", "copies", "side"))
        vectors, signatures = np.stack([unit(c, dim) for c in rows["cell"]]), np.frombuffer(b"".join(rows["signature"]), np.int16).reshape(-1, PREFIX)
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if within:
            i, j = compare((vectors, signatures), None, point, threshold)
        elif len(first) and len(second):
            i, j = compare((vectors[first], signatures[first]), (vectors[second], signatures[second]), point, threshold)
            i, j = first[i], second[j]
        else:
            i = j = np.zeros(0, np.int64)
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        label = _components(len(ids), i, j, np.arange(len(ids)))
        at = np.flatnonzero(links)
        return ids[at], links[at], ids[label[at]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {c: [] for c in ROWS}

        def done() -> Iterator[pa.RecordBatch]:
            if len(held["id"]) > 1:
                found = links_of(held, key[3] == key[4], key[2], key[1])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["id", "links", "joined"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in KEYS), strict=True))
            edges = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]]
            own = {c: batch.column(c).to_pylist() for c in ROWS}
            for start, end in zip([0, *edges], [*edges, len(keys)], strict=True):
                if start < end:
                    if keys[start] != key:
                        yield from done()
                        key, held = keys[start], {c: [] for c in ROWS}
                    for c in ROWS:
                        held[c] += own[c][start:end]
        yield from done()

    return run


def classes_of(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): vec_id and key of each row; each distinct vector of a label once, with its copies and an id."""
    plain = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), as_doubles(F.col("embedding")).alias("vector"))
    keyed = materialise(map_batches(plain, _keyed, "vec_id long, label string, key binary, dim int, cell binary"), "keyed-vectors")
    classes = keyed.where("key IS NOT NULL").groupBy("key").agg(*(F.any_value(c).alias(c) for c in ("label", "dim", "cell")), F.count("*").alias("copies"), F.min("vec_id").alias("smallest"))
    return keyed.select("vec_id", "key"), materialise(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")


def class_links(classes: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(id, links, joined) by unit: how many rows a class links to there, and the class that it is joined to by a tree."""
    spark = classes.sparkSession
    count = 1 << min(max(ceil(log2(max(1, classes.count()) / 64)), int(log2(FEWEST))), int(log2(MOST)))
    by_dim: dict[int, list] = {}
    for r in classes.select("key", "dim", "cell").orderBy("key").limit(SAMPLE * count).collect():  # the digests deal a random order
        by_dim.setdefault(r[1], []).append(unit(r[2], r[1]))
    points = spark.sparkContext.broadcast({d: reference_points(np.stack(x), d, count) for d, x in by_dim.items()})  # SAMPLE * count vectors at most

    def described(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells = []
        for d, c in zip(batch.column("dim").to_pylist(), batch.column("cell").to_pylist(), strict=True):
            cells.append((d, unit(c, d)))
        out: list = [None] * len(cells)
        for d in {d for d, _ in cells}:
            if d not in points.value:
                points.value[d] = reference_points(np.zeros((0, d)), d, count)
            at = [k for k, (own, _) in enumerate(cells) if own == d]
            for k, s in zip(at, nearest_points(np.stack([cells[k][1] for k in at]), points.value[d]), strict=True):
                out[k] = s
        rarest = [np.sort(s)[: PREFIX - SHARED + 1].astype(np.int32).tolist() for s in out]
        named = [batch.column(c) for c in ("id", "label", "dim", "copies", "cell")]
        return pa.RecordBatch.from_arrays([*named, pa.array([s.tobytes() for s in out], pa.binary()), pa.array(rarest, pa.list_(pa.int32()))], ["id", "label", "dim", "copies", "cell", "signature", "points"])

    found = map_batches(classes.select("id", "label", "dim", "copies", "cell"), described, "id long, label string, dim int, copies long, cell binary, signature binary, points array<int>")
    found = materialise(found, "pivot-signatures")
    listed = found.withColumn("point", F.explode("points")).drop("points")
    by_list = ["label", "dim", "point"]
    sizes = materialise(found.select("label", "dim", F.explode("points").alias("point")).groupBy(*by_list).count().where("count > 1").select(*by_list, F.ceil(F.col("count") / block).cast("int").alias("blocks")), "list-sizes")
    listed = listed.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_KEYS else sizes, by_list)
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    listed = listed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = listed.select("*", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second")).withColumn("side", (F.col("own") > F.col("other")).cast("int"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)  # work outweighs bytes
    dealt = units.select(*KEYS, *ROWS).repartition(tasks, *KEYS).sortWithinPartitions(*KEYS)
    return dealt.mapInArrow(_unit_links(threshold), "id long, links long, joined long")


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98, block: int = BLOCK) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept.

    Only vectors of one label that is not null, and of one length, are compared. A vector that is null, empty, zero or
    holds a null or non-finite component links with nothing and is kept. Every row is a vector: repeated rows link with
    each other and tie for the component's name; a null vec_id links like any other but names a component only where
    there is no other, and is not kept then. Extra columns are ignored; an empty table gives an empty result.
    """
    rows, classes = classes_of(embeddings)
    links = materialise(class_links(classes, threshold, block), "class-links")
    roots = connected_components(links.select(F.col("id").alias("a"), F.col("joined").alias("b")))
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    rooted = classes.select("id", "key", "copies", "smallest").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("smallest").alias("component")), "root").join(counts, "id", "left")
    facts = named.select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component")
    alone = rows.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = rows.where("key IS NOT NULL").join(facts, "key").select("vec_id", "n_links", F.col("component").alias("component_id")).unionByName(alone)
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
