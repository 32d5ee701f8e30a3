"""Operators on embeddings against brute force."""

import hashlib
import math

import numpy as np
import pytest

from helixframe.llm.centroid_clustering import COARSE_FIRST, cluster, hadamard, nearest, restored, transformed
from helixframe.llm.embedding_dedup import class_links, classes_of, near_duplicates, nearest_points, reference_points

SCHEMA = "vec_id long, embedding array<float>, label int, _row int, key string, cell int"
WIDE = "vec_id long, embedding array<double>, label int"


def frame(spark, rows, schema=WIDE):
    return spark.createDataFrame(rows, schema).repartition(3)


def test_transform_is_exact():
    x = np.random.default_rng(1).integers(-(1 << 24), 1 << 24, (5, 64))
    assert [restored(r.tolist()) for r in transformed(x)] == x.tolist()
    assert COARSE_FIRST[0] == 0 and sorted(COARSE_FIRST.tolist()) == list(range(64))
    assert (hadamard(hadamard(x)) == 64 * x).all()


@pytest.mark.parametrize("spread", [3, 1000, 1 << 24])
def test_nearest_equals_plain_distances_with_ties(spread):
    rng = np.random.default_rng(spread)
    rows, centroids = rng.integers(-spread, spread + 1, (300, 64)), rng.integers(-spread, spread + 1, (8, 64))
    centroids[5] = centroids[2]
    rows[:8] = centroids
    rows[10] = centroids[2]
    number, distance = nearest(transformed(rows), transformed(centroids))
    plain = ((rows[:, None].astype(object) - centroids[None]) ** 2).sum(2)
    assert number.tolist() == [int(np.argmin(p)) for p in plain]
    assert distance.tolist() == [min(p) for p in plain]


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    centroids = [v for _, _, v in sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        number = [j for _, j in assign()]
        for j in range(len(centroids)):
            own = [v for (_, v), n in zip(kept, number, strict=True) if n == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    inertia = {j: sum(d for d, n in found if n == j) for j in range(k)}
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, found, strict=True)), key=str)


def test_clusters_equal_plain_lloyd(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((5, 64))
    rows = [(i, (centres[i % 5] + 0.3 * rng.standard_normal(64)).tolist()) for i in range(150)]
    rows += [(500, None), (501, [1.0] * 63), (502, [math.nan] + [0.0] * 63), (503, [None] + [0.0] * 63), (504, [math.inf] + [0.0] * 63), (505, []), (None, [0.5] * 64), (7, rows[7][1])]
    got = cluster(frame(spark, [(*r, 1) for r in rows])).collect()
    assert sorted(map(tuple, got), key=str) == plain_clusters(rows)


def test_clusters_of_odd_tables(spark):
    assert cluster(frame(spark, [])).count() == 0
    assert [tuple(r) for r in cluster(frame(spark, [(None, [1.0] * 64, 0)])).collect()] == [(None, None, None, None, None, None)]
    few = cluster(frame(spark, [(1, [0.0] * 64, 0), (2, [1.0] * 64, 0), (3, [1e9] * 64, 0)])).orderBy("vec_id").collect()
    assert [(r.vec_id, r.distance) for r in few] == [(1, 0), (2, 0), (3, None)] and few[0].inertia == 0
    clash = frame(spark, [(1, [0.0] * 64, 0, 5, "k", 6)], SCHEMA)
    assert cluster(clash).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain_links(rows, threshold=0.98):
    ok = [e is not None and len(e) > 0 and all(x is not None and math.isfinite(x) for x in e) and any(e) and lab is not None for _, e, lab in rows]
    links = [set() for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], float) for k in (a, b))
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        name = min(ids) if ids else None
        out.append((rows[a][0], len(links[a]), name, rows[a][0] is not None and rows[a][0] == name))
    return sorted(out, key=str)


def near(rng, base, cos):
    noise = rng.standard_normal(len(base))
    noise -= (noise @ base) / (base @ base) * base
    unit = base / np.linalg.norm(base)
    return cos * unit + math.sqrt(1 - cos * cos) * noise / np.linalg.norm(noise)


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(64).astype(np.float32).tolist(), i % 3) for i in range(300)]
    group = rng.standard_normal(64)
    rows += [(1000 + i, near(rng, group, 0.993).tolist(), 1) for i in range(150)]  # a dense group
    rows += [(2000 + i, rows[5][1], rows[5][2]) for i in range(40)]  # exact copies
    rows += [(2100, [2 * x for x in rows[5][1]], rows[5][2]), (2101, rows[5][1], 1 - rows[5][2] % 2)]
    rows += [(3000 + i, near(rng, np.array(rows[i][1]), 0.985).tolist(), rows[i][2]) for i in range(20, 90)]
    return rows


def test_links_equal_brute_force(spark, planted):
    got = near_duplicates(frame(spark, planted)).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == plain_links(planted)


def test_blocks_change_nothing(spark, planted):
    """Lists cut into many blocks give the same rows."""
    got = near_duplicates(frame(spark, planted), block=16).collect()
    assert sorted(map(tuple, got), key=str) == plain_links(planted)


def test_no_pair_is_found_twice_and_work_returns_a_row_a_class(spark, planted):
    _, classes = classes_of(frame(spark, planted))
    found = class_links(classes, 0.98).toPandas()
    dense = classes.where("smallest >= 1000 AND smallest < 2000").select("id").toPandas()["id"]
    assert len(found[found["id"].isin(dense)]) <= 8 * len(dense)
    assert found.groupby("id")["links"].sum().max() <= 150


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold, the hardest: measured recall of the index on 2,000 of them."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(2000):
        base = rng.standard_normal(64)
        rows += [(2 * i, base.tolist(), 0), (2 * i + 1, near(rng, base, 0.9801).tolist(), 0)]
    found = near_duplicates(frame(spark, rows)).where("n_links > 0").count()
    assert found >= 0.99 * len(rows)


def test_links_of_odd_rows(spark):
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [1.0, math.nan], 0), (6, [1.0, 0.0], None), (7, [1.0, 0.0], 0), (8, [1.0, 0.0, 0.0], 0), (9, [1e300, 0.0], 0), (None, [1.0, 0.0], 0), (7, [1.0, 0.0], 0), (10, [-1.0, 0.0], 0)]
    got = near_duplicates(frame(spark, rows)).collect()
    want = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 8, 10)] + [(7, 3, 7, True), (7, 3, 7, True), (9, 3, 7, False), (None, 3, 7, False)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert near_duplicates(frame(spark, [])).count() == 0
    clash = frame(spark, [(1, [1.0, 2.0], 0, 5, "k", 6), (2, [1.0, 2.0], 0, 5, "k", 6)], SCHEMA)
    assert [tuple(r) for r in near_duplicates(clash).orderBy("vec_id").collect()] == [(1, 1, 1, True), (2, 1, 1, False)]


def test_reference_points_keep_a_dense_group_to_one():
    rng = np.random.default_rng(5)
    base = rng.standard_normal(64)
    sample = np.stack([near(rng, base, 0.99) for _ in range(300)] + [x / np.linalg.norm(x) for x in rng.standard_normal((20, 64))])
    points = reference_points(sample, 64, 64)
    assert ((points @ base / np.linalg.norm(base)) > 0.9).sum() == 1 and nearest_points(sample, points).shape == (320, 10)
