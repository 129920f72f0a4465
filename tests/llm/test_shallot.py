import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from narrascope.llm.shallot import Centroids, cluster_query, search, shallot_clusters, whole_vectors


def plain(rows, k=40, rounds=5):
    """Clusters by comparing each vector with each centroid, in unbounded integers."""
    rows = [(i, tuple(x)) for i, x in rows]
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in rows if i is not None)[:k]
    points = [x for _, x in seeds]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, p)), c) for c, p in enumerate(points))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in rows]
        for c in range(len(points)):
            members = [x for (_, x), o in zip(rows, own) if o == c]
            if members:
                points[c] = tuple(sum(v) // len(members) for v in zip(*members))
    found = [(i, *nearest(x)) for i, x in rows]
    inertia = {c: sum(d for _, d, o in found if o == c) for c in range(len(points))}
    cap = lambda v: min(v, (1 << 63) - 1)
    return sorted(((i, c, cap(d), cap(sum(cap(e) for _, e, o in found if o == c)), cap(sum(cap(e) for _, e, _ in found)),
                    hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()) for i, d, c in found), key=str) if inertia else []


def vectors(seed, n, spread=0.2, shape=64):
    r = random.Random(seed)
    blobs = [[r.uniform(-1, 1) for _ in range(shape)] for _ in range(12)]
    return [(i, [float(np.float32(v + r.gauss(0, spread))) for v in r.choice(blobs)]) for i in range(n)]


def whole(rows):
    return [(i, [int(np.floor(v * 256)) for v in x]) for i, x in rows]


def found(spark, rows):
    return sorted((tuple(r) for r in cluster_query(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)).collect()),
                  key=str)


@pytest.mark.parametrize("spread", [0.01, 0.3, 3.0])
def test_against_all_distances(spark, spread):
    rows = vectors(1, 300, spread)
    rows += [rows[3], rows[4], (None, rows[5][1]), (7, rows[8][1])]
    nan = float("nan")
    odd = [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [nan] * 64), (905, [None] + [0.1] * 63), (906, [float("inf")] * 64)]
    assert found(spark, [(i, x, 0) for i, x in rows + odd]) == plain(whole(rows))


def test_ties_and_few_vectors(spark):
    r = random.Random(2)
    same = [(i, [0.25] * 64) for i in range(60)] + [(i + 100, [float(r.choice([0, 0.5]))] * 2 + [0.0] * 62) for i in range(60)]
    assert found(spark, [(i, x, 0) for i, x in same]) == plain(whole(same))
    for n in (1, 2, 5):
        assert found(spark, [(i, x, 0) for i, x in vectors(3, n)]) == plain(whole(vectors(3, n)))
    assert found(spark, [(900, None, 0)]) == []
    assert found(spark, [(None, [0.5] * 64, 0)]) == []


def test_large_components(spark):
    r = random.Random(4)
    rows = [(i, [float(np.float32(r.uniform(-1, 1) * 10 ** r.choice([0, 6, 9, 14]))) for _ in range(64)]) for i in range(90)]
    assert found(spark, [(i, x, 0) for i, x in rows]) == plain(whole(rows))


def test_any_k_rounds_and_length(spark):
    rows = whole(vectors(5, 200, 0.2, 6))
    table = spark.createDataFrame(rows, "vec_id long, x array<long>")
    for k, rounds in ((1, 2), (2, 3), (7, 0), (7, 9)):
        done, centroids, _ = shallot_clusters(table, F.sha2(F.concat(F.lit("2:"), "vec_id"), 256), k, rounds, 6)
        assert sorted((r.vec_id, r.cluster, r.distance, centroids.digest(r.cluster)) for r in done.collect()) == sorted(
            (i, c, d, h) for i, c, d, _, _, h in plain(rows, k, rounds))


def test_bounds_settle_most_vectors_and_hold():
    r = np.random.default_rng(0)
    x = (r.normal(0, 30, (500, 8)) + r.integers(0, 6, (500, 1)) * 400).astype(np.int64)
    points = Centroids(x[:6].copy())
    state = search(x, points, np.zeros(500, np.int32), np.ones(500, np.int32), np.full(500, np.inf), np.zeros(500), True)
    moved = Centroids(points.points + r.integers(-3, 4, (6, 8)), points)
    first, _, upper, lower, distance = search(x, moved, *state[:4], False)
    true = ((x[:, None, :] - moved.points[None]) ** 2).sum(2)
    assert (first == true.argmin(1)).all() and (distance < 0).mean() > 0.5
    assert (upper ** 2 >= true.min(1)).all() and (lower ** 2 <= np.sort(true, 1)[:, 1]).all()


def test_vectors_are_floored(spark):
    rows = [(1, [0.5, -0.001]), (2, [1e30, -1e30]), (3, [0.5])]
    found_ = {r.vec_id: r.x for r in whole_vectors(spark.createDataFrame(rows, "vec_id int, embedding array<double>"), 2).collect()}
    assert found_ == {1: [128, -1], 2: [1 << 62, -(1 << 62)]}
