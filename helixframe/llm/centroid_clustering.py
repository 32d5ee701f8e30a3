"""Centroid clustering by Walsh-Hadamard progressive search (operator 11).

Vectors become integers and are transformed once, exactly, by the Walsh-Hadamard transform; a squared distance is then
the sum of squared coefficient differences over 64. Each search adds these up from the coarsest coefficients to the
finest, in powers of two, and drops a centroid as soon as its part exceeds the whole distance of the leading one, which
it then cannot beat or tie. A round is one pass over the written coefficients; a task returns one row of sums for each
centroid, and sums of coefficients are turned back into exact sums of components on the driver (8 x 64 numbers).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import materialise
from helixframe.llm.vectors import as_doubles, vectors

WIDTH, SCALE = 64, 1024
#: Integers up to this size keep every sum of squares below 2 ** 63.
LARGEST = 1 << 24
LEVELS = (1, 2, 4, 8, 16, 32, 64)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The unnormalised Walsh-Hadamard transform of each row, in natural order; twice gives WIDTH times the rows."""
    h = 1
    while h < x.shape[1]:
        pairs = x.reshape(len(x), -1, 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), -1)
        h *= 2
    return x


#: Places of the natural order by falling coarseness: by the number of sign changes of their basis function.
COARSE_FIRST = np.argsort((np.diff(hadamard(np.eye(WIDTH, dtype=np.int64)), axis=1) != 0).sum(1), kind="stable")


def transformed(integers: np.ndarray) -> np.ndarray:
    return hadamard(integers)[:, COARSE_FIRST]


def restored(coefficients: list[int]) -> list[int]:
    """The integers whose transform is ``coefficients``, exact at any size."""
    natural = np.empty(WIDTH, object)
    natural[COARSE_FIRST] = coefficients
    return [int(x) // WIDTH for x in hadamard(natural[None, :])[0]]


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row, both given as coefficients, coarse ones first.

    Ties go to the smaller number.
    """
    n, k = len(rows), len(centroids)
    alive, sums = np.ones((n, k), bool), np.zeros((n, k), np.int64)
    leader, bound, done = np.full(n, -1), np.zeros(n, np.int64), 0
    for end in LEVELS:
        for j in range(k):
            at = np.flatnonzero(alive[:, j])
            difference = rows[at, done:end] - centroids[j, done:end]
            sums[at, j] += (difference * difference).sum(1)
        done = end
        if end < WIDTH:
            now = np.where(alive, sums, np.iinfo(np.int64).max).argmin(1)
            moved = np.flatnonzero(now != leader)
            difference = rows[moved] - centroids[now[moved]]
            whole = (difference * difference).sum(1)
            bound[moved] = np.where(leader[moved] < 0, whole, np.minimum(whole, bound[moved]))
            leader = now
            alive &= sums <= bound[:, None]
    best = np.where(alive, sums, np.iinfo(np.int64).max)
    number = best.argmin(1)
    return number, best[np.arange(n), number] // WIDTH


def _coefficients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out, keep = batch.column("vec_id"), [], []
        for k, vector in enumerate(vectors(batch.column("vector"))):
            if vector is not None and len(vector) == WIDTH:
                keep.append(k)
                out.append(np.floor(SCALE * vector))
        whole = np.array(out).reshape(-1, WIDTH)
        fits = (np.abs(whole) <= LARGEST).all(1)
        coefficients = transformed(np.where(fits[:, None], whole, 0).astype(np.int64)).astype("<i4")
        cells = [row.tobytes() if ok else None for row, ok in zip(coefficients, fits, strict=True)]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(cells, pa.binary())], ["vec_id", "coefficients"])


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("coefficients").to_pylist()), "<i4").reshape(-1, WIDTH).astype(np.int64)


def kept_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, coefficients): the transform of each kept vector; null where an integer exceeds LARGEST."""
    return materialise(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), as_doubles(F.col("embedding")).alias("vector")).mapInArrow(_coefficients, "vec_id long, coefficients binary"), "coefficients")


def _sums(rows: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """(rows, sums of coefficients) by nearest centroid; at most one row a task and centroid is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), WIDTH), np.int64)
        for batch in batches:
            own = _rows(batch)
            number, _ = nearest(own, centroids)
            np.add.at(total, number, own)
            count += np.bincount(number, minlength=len(centroids))
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at]), pa.array(total[at].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = rows.mapInArrow(run, "cluster int, n long, total array<long>")
    whole = [F.sum(F.get("total", F.lit(k)).cast("decimal(38,0)")).alias(f"c{k}") for k in range(WIDTH)]
    return {r[0]: (int(r[1]), [int(x) for x in r[2:]]) for r in parts.groupBy("cluster").agg(F.sum("n"), *whole).collect()}  # a row a centroid


def cluster(embeddings: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3") -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly 64 components without a null or non-finite one; others return no row. The centroids start
    as the ``k`` vectors with smallest sha256 of seed:vec_id (rows without an id cannot start one; of rows with one id
    that with the smallest coefficients comes first; fewer vectors make fewer centroids). Repeated rows count each time,
    and rows with a null id take part. A vector with a component of 16384 or more in size cannot be measured in whole
    longs: it returns null in all columns but vec_id, as does every row where no centroid can start. Extra columns are
    ignored; an empty table gives an empty result.
    """
    kept = kept_vectors(embeddings)
    rows = kept.where("coefficients IS NOT NULL")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id IS NOT NULL").select(order.alias("h"), "coefficients").orderBy("h", "coefficients").limit(k).collect()  # k rows
    if not first:
        return kept.selectExpr("vec_id", "CAST(NULL AS int) AS cluster", "CAST(NULL AS long) AS distance", "CAST(NULL AS long) AS cluster_inertia", "CAST(NULL AS long) AS inertia", "CAST(NULL AS string) AS centroid_sha256")
    coefficients = np.array([np.frombuffer(r[1], "<i4") for r in first]).astype(np.int64)
    integers = [restored(c.tolist()) for c in coefficients]
    for _ in range(rounds):
        for number, (n, total) in _sums(rows, coefficients).items():
            integers[number] = [x // n for x in restored(total)]
        coefficients = transformed(np.array(integers, np.int64))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = batch.filter(batch.column("coefficients").is_valid())
            number, distance = nearest(_rows(there), coefficients)
            yield pa.RecordBatch.from_arrays([there.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = materialise(rows.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in integers]
    sums = {r[0]: int(r[1]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # a row a centroid
    table = [(j, sums.get(j, 0), sum(sums.values()), name) for j, name in enumerate(names)]
    table = [(j, *(x if x < 1 << 63 else None for x in (own, total)), name) for j, own, total, name in table]
    facts = embeddings.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return found.unionByName(kept.where("coefficients IS NULL").select("vec_id"), allowMissingColumns=True)


def clustering_sql(k: int = 8, rounds: int = 10, seed: str = "3") -> str:
    """The same in DuckDB's SQL, by plain distances, for vectors of components below 16384."""
    assign = """a{r} AS (SELECT vec_id, v, cluster, distance FROM (
  SELECT k.vec_id, k.v, c.cluster, list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance,
         row_number() OVER (PARTITION BY k.vec_id ORDER BY distance, c.cluster) AS place FROM kept k CROSS JOIN c{r} c) WHERE place = 1)"""
    step = """m{r} AS (SELECT cluster, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM (
  SELECT cluster, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY cluster, i),
c{s} AS (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT cluster, list(x ORDER BY i) AS v FROM m{r} GROUP BY cluster) m ON c.cluster = m.cluster)"""
    parts = [
        f"""kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH})""",
        f"c0 AS (SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS cluster, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds):
        parts += [assign.format(r=r), step.format(r=r, s=r + 1)]
    parts.append(assign.format(r=rounds))
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, a.cluster, distance, (sum(distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster"""
