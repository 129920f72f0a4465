import random

import numpy as np
from pyspark.sql import functions as F

from narrascope.llm.ball_tree import BallTree, quantised, search_query, search_top_k


def plain(rows, k=5):
    out = set()
    for q, x in {(i, tuple(x)) for i, x in rows if x and i is not None and i % 50 == 0}:
        # Every row but the query's own is a candidate, repeated ones too.
        best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if y and i is not None and i != q and len(y) == len(x))[:k]
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    return out


def test_against_all_pairs(spark, monkeypatch):
    import narrascope.llm.ball_tree as module

    for name, size in (("SHARD", 90), ("BLOCK", 3), ("LEAF", 8)):
        monkeypatch.setattr(module, name, size)
    r = random.Random(6)
    rows = [(i, [r.randint(-3, 3) for _ in range(4)]) for i in range(700)]
    rows += [(1000, None), (1001, []), (None, [1, 2, 3, 4]), (1002, [1, 2]), (1050, [1, 2]), rows[50], rows[51], *[(9, [9, 9, 9, 9])] * 7, *[(8, [-9, 9, -9, 9])] * 3]
    found = search_top_k(spark.createDataFrame(rows, "vec_id long, x array<long>"), F.col("vec_id") % 50 == 0)
    assert {tuple(r) for r in found.collect()} == plain(rows) and found.count() == len(plain(rows))


def test_fewer_candidates_than_k_and_none(spark):
    vectors = spark.createDataFrame([(0, [1]), (1, [2]), (2, [2])], "vec_id long, x array<long>")
    rows = search_top_k(vectors, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [tuple(r) for r in rows] == [(0, 1, 1, 2), (0, 2, 2, 2)]
    assert search_top_k(vectors.limit(0), F.lit(True)).count() == 0


def test_parts_are_floored_and_odd_vectors_left_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.001]), (1, [nan, 1.0]), (2, [inf, 1.0]), (3, [None, 1.0]), (4, None), (50, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {r.vec_id: r.x for r in quantised(vectors).collect()} == {0: [128, -1], 1: None, 2: None, 3: None, 4: None, 50: [256, 256]}
    assert {tuple(r) for r in search_query(vectors.withColumn("score", F.lit(1))).collect()} == {(0, 1, 50, 32512), (50, 1, 0, 32512)}


def test_bounds_hold():
    r = np.random.default_rng(0)
    points, queries = r.integers(-50, 50, (500, 6)).astype(float), r.integers(-50, 50, (20, 6)).astype(float)
    tree = BallTree(points)
    bounds = tree.bounds(queries)
    for n in range(len(tree.start)):
        assert (tree.points[tree.start[n]:tree.end[n]] @ queries.T <= bounds[:, n]).all()
    assert sorted(tree.order) == list(range(500))


def test_repeated_rows_are_all_candidates(spark):
    vectors = spark.createDataFrame([(0, [1, 1])] * 2 + [(1, [5, 5])] * 3 + [(2, [4, 4])] + [(3, [3, 3])] * 9, "vec_id long, x array<long>")
    rows = search_top_k(vectors, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in rows] == [(1, 10)] * 3 + [(2, 8), (3, 6)]
