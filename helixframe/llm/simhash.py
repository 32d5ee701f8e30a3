"""SimHash near-duplicates by a binary trie self-join (operator 2).

Two fingerprints within three bits differ in at most one bit in one of their two 32-bit halves. So the trie is walked
twice, once with each half on top: node pairs go down together, the differing bits add up, and a pair is dropped once
it has used more than one bit in the upper half or three in all. Fingerprints are dealt to tasks by their first bits; a
fingerprint also visits the subtries whose first bits differ from its own in one place. A task links what it finds by
trees (one row a fingerprint), so a dense group costs no row per pair, and the trees are joined into components by
star contraction.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import ROW, map_batches, materialise, numbered, unused, without

#: Fingerprints wanted in a subtrie, and how many make it hot: families of near copies share their first bits. A hot one
#: is dealt again by all 32 bits of the upper half, so a task holds what shares these but for one bit.
SUBTRIE, HOT = 4096, 1 << 16

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE = 256 * np.arange(8)


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles (A-Z lower-cased); zero without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < width:
        return h(b" ".join(words), seed)
    hashes = [h(b" ".join(s), seed) for s in zip(*(words[k:] for k in range(width)), strict=False)]
    values = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    seen = np.bincount((values + _BYTE).ravel(), minlength=2048).reshape(8, 256)
    return int.from_bytes(np.packbits((2 * (seen @ _BITS)).ravel() > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, fp) and the long columns ``more``: the fingerprint of each document as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), *(batch.column(c) for c in more)], ["doc_id", "fp", *more])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), *more)
    return map_batches(rows, run, ", ".join(["doc_id long, fp long", *(f"{c} long" for c in more)]))


def _components(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smallest label reachable over the links a-b, by hooking and pointer jumping."""
    while True:
        la, lb = label[a], label[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        if (low == high).all():
            return label
        parent = np.arange(n)
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def trie_labels(values: np.ndarray, roots: list[tuple[int, int, int, int, int]], depth: int, budget: int = 3, upper: int = 1) -> np.ndarray:
    """A label for each of ``values``, equal where links connect them.

    ``roots``: node pairs (start and end of one range, of the other, differing bits so far) at ``depth``; every range is
    sorted and shares its first ``depth`` bits. Walked with 1 to ``budget`` bits in turn, so that what is linked already
    needs no second look: a pair of nodes that lie in one component is dropped.
    """
    n = len(values)
    label = np.arange(n)
    for allowed in range(budget + 1):
        a0, a1, b0, b1, used = (np.array(x, np.int64) for x in zip(*roots, strict=True))
        new = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])]) if n else np.zeros(0, np.int64)
        links: list[tuple[np.ndarray, np.ndarray]] = []
        for bit in range(depth, 64):
            most = min(allowed, upper) if bit < 32 else allowed
            ones = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - bit)) & np.uint64(1)).astype(np.int64)])
            am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
            same = (a0 == b0) & (a1 == b1)
            cross = ~same & (used < most)
            up = used < most
            parts = (
                (a0, am, b0, bm, used, np.ones(len(a0), bool)),
                (am, a1, bm, b1, used, np.ones(len(a0), bool)),
                (a0, am, bm, b1, used + 1, up),
                (am, a1, b0, bm, used + 1, cross),
            )
            a0, a1, b0, b1, used = (np.concatenate([p[k][p[5]] for p in parts]) for k in range(5))
            alone = (a0 == b0) & (a1 == b1) & (a1 - a0 < 2)
            keep = (a1 > a0) & (b1 > b0) & ~alone
            a0, a1, b0, b1, used = (x[keep] for x in (a0, a1, b0, b1, used))
            one = (label[a0] == label[b0]) & (new[a0] == new[a1 - 1]) & (new[b0] == new[b1 - 1])
            a0, a1, b0, b1, used = (x[~one] for x in (a0, a1, b0, b1, used))
            if not len(a0):
                break
        else:
            links.append((a0, b0))
        for a, b in links:
            label = _components(n, a, b, label)
    return label


def _subtrie_links(group: pd.DataFrame) -> pd.DataFrame:
    prefix = int(group["depth"].iloc[0])
    values = group["value"].to_numpy(np.int64).view(np.uint64)
    order = np.lexsort((values, group["guest"].to_numpy()))
    values, guest = values[order], group["guest"].to_numpy()[order]
    home = int((~guest).sum())
    roots = [(0, home, 0, home, 0)] if home else []
    if home and home < len(values):
        top = values[home:] >> np.uint64(64 - prefix)
        starts = np.concatenate([[0], np.flatnonzero(top[1:] != top[:-1]) + 1, [len(top)]]) + home
        roots += [(0, home, int(s), int(e), 1) for s, e in zip(starts[:-1], starts[1:], strict=True)]
    if not roots:
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    label = trie_labels(values, roots, prefix)
    linked = label != np.arange(len(values))
    if group["turned"].iloc[0]:
        values = (values << np.uint64(32)) | (values >> np.uint64(32))
    return pd.DataFrame({"a": values.view(np.int64)[linked], "b": values.view(np.int64)[label[linked]]})


def _visits(first: int, last: int) -> Column:
    """The column ``value`` with each of its bits ``first`` to ``last`` - 1 that is set put out: where it is a guest."""
    bits = [F.lit(1 << (63 - k)) if k else F.lit(-(1 << 63)) for k in range(first, last)]
    return F.filter(F.array(*(F.when(F.col("value").bitwiseAND(b) != 0, F.col("value").bitwiseXOR(b)) for b in bits)), lambda x: x.isNotNull())


def fingerprint_links(distinct: DataFrame, rows: int) -> DataFrame:
    """Trees (a, b) that connect the fingerprints ``fp`` (distinct) within three bits of each other."""
    prefix = min(24, max(7, ceil(log2(max(1, rows) / SUBTRIE))))
    turned = (F.shiftleft("fp", 32)).bitwiseOR(F.shiftrightunsigned("fp", 32))
    values = distinct.select(F.explode(F.array(F.struct(F.lit(False).alias("turned"), F.col("fp").alias("value")), F.struct(F.lit(True).alias("turned"), turned.alias("value")))).alias("v")).select("v.*")
    subtrie = lambda c, depth: F.shiftrightunsigned(c, 64 - depth)
    hot = values.groupBy("turned", subtrie("value", prefix).alias("subtrie")).agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("turned", "subtrie", F.lit(True).alias("hot"))
    guests = F.transform(_visits(0, prefix), lambda x: F.struct(x.alias("at"), F.lit(True).alias("guest")))
    dealt = values.select("turned", "value", F.explode(F.concat(F.array(F.struct(F.col("value").alias("at"), F.lit(False).alias("guest"))), guests)).alias("p")).select("turned", "value", "p.*")
    dealt = dealt.withColumn("subtrie", subtrie("at", prefix)).join(materialise(hot, "hot-subtries"), ["turned", "subtrie"], "left")
    cool = dealt.where("hot IS NULL").select("turned", "value", "guest", F.lit(prefix).alias("depth"), "subtrie")
    deep = dealt.where("hot").select("turned", "value", "guest", F.lit(32).alias("depth"), subtrie("at", 32).alias("subtrie"))
    near = dealt.where("hot AND NOT guest").select("turned", "value", F.explode(_visits(prefix, 32)).alias("at")).select("turned", "value", F.lit(True).alias("guest"), F.lit(32).alias("depth"), subtrie("at", 32).alias("subtrie"))
    return cool.unionByName(deep).unionByName(near).groupBy("turned", "depth", "subtrie").applyInPandas(_subtrie_links, "a long, b long")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over the links (a, b), for each node that has a link.

    Alternates large-star and small-star contraction until nothing changes; each round is a written table.
    """

    def stars(edges: DataFrame) -> DataFrame:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        pairs = down.join(lowest, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        return pairs.where("a <> b").distinct()

    def state(edges: DataFrame) -> tuple:
        return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()[:]

    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    last = state(edges)
    while last[0]:
        edges = materialise(stars(edges), "links")
        now = state(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _rooted(prints: DataFrame, first: Column) -> DataFrame:
    """(fp, first, root): each fingerprint with the smallest ``first`` of its rows and the root of its component."""
    distinct = materialise(prints.groupBy("fp").agg(F.min(first).alias("first")), "distinct-fingerprints")
    roots = connected_components(fingerprint_links(distinct.select("fp"), distinct.count()))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def representatives(docs: DataFrame) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id, with all its columns.

    A null doc_id counts as larger than any other; of several rows with the smallest one stays. Null and empty texts have
    fingerprint zero and are one group; extra columns stay; an empty table gives an empty result.
    """
    row = unused(docs.columns, ROW)
    rows = numbered(docs, "rows", row)
    prints = materialise(fingerprints(rows.select("doc_id", "text", F.col(row).alias(ROW)), ROW), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW)
    chosen = _rooted(prints, order).groupBy("root").agg(F.min("first").alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    return without(rows, prints.select(ROW).join(chosen, ROW, "left_anti").withColumnRenamed(ROW, row), row).select(docs.columns)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    A text that is null or has no words has fingerprint zero and links like any other. Repeated rows each return a row;
    a null doc_id is a row like any other, and a component is named null only where it has no other id; extra columns
    are ignored; an empty table gives an empty result.
    """
    prints = materialise(fingerprints(docs), "fingerprints")
    rooted = _rooted(prints, F.col("doc_id"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(lowest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
