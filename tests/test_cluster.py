import random
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from narrascope.operators import cluster as C
from narrascope.operators.components import connected_components


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("seed", [0, 1])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    union = Union()
    for a, b in edges:
        if a != b:
            union.join(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: union.find(n) for n in union.up}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_clusters(points, levels, size):
    """The definition of the operator as a plain recursion over in-memory cells."""
    dims = len(points[0])
    low = [min(p[a] for p in points) for a in range(dims)]
    span = max(max(p[a] for p in points) - low[a] for a in range(dims))
    regions, sizes = [], []
    for level in range(levels + 1):
        cells = defaultdict(list)
        for i, p in enumerate(points):
            fine = [min(int((p[a] - low[a]) / span * 2 ** levels), 2 ** levels - 1) for a in range(dims)]
            cells[tuple(c >> (levels - level) for c in fine)].append(i)

        def around(c):
            return [n for d in product((-1, 0, 1), repeat=dims) if (n := tuple(x + y for x, y in zip(c, d))) in cells]

        dense = {c for c in cells if sum(len(cells[n]) for n in around(c)) >= size}
        union = Union()
        for c in dense:
            union.find(c)
            for n in around(c):
                if n in dense:
                    union.join(c, n)
        members = defaultdict(list)
        for c in dense:
            members[union.find(c)] += cells[c]
        regions.append({k: set(v) for k, v in members.items() if len(v) >= size})

    def children(level, inside):
        return [(level + 1, m) for m in regions[level + 1].values() if m <= inside] if level < levels else []

    def walk(level, inside, whole):
        mass, chain = 0.0, inside
        while True:
            mass += len(chain) * (1.0 if level == 0 else 2.0 ** (level - 1))
            below = children(level, chain)
            if len(below) != 1:
                break
            level, chain = below[0]
        parts = [walk(*b, False) for b in below]
        under = sum(m for m, _ in parts)
        if not whole and mass >= under:
            return mass, [inside]
        return max(mass, under), [c for _, found in parts for c in found]

    top = list(regions[0].values())
    return walk(0, top[0], True)[1] if top else []


def planted(seed, hot=0):
    rng = random.Random(seed)
    points = [(rng.gauss(cx, s), rng.gauss(cy, s)) for cx, cy, s, n in ((0, 0, 0.3, 60), (8, 1, 0.4, 45), (3, 9, 0.2, 30)) for _ in range(n)]
    points += [(rng.uniform(-4, 12), rng.uniform(-4, 12)) for _ in range(30)]
    return points + [points[0]] * hot


@pytest.mark.parametrize("seed, hot", [(0, 0), (1, 0), (2, 120)])
def test_clusters_equal_the_definition(spark, seed, hot):
    points = planted(seed, hot)
    frame = spark.createDataFrame([(i, list(p)) for i, p in enumerate(points)], "doc_id long, reduced array<double>").repartition(3)
    rows = C.density_cluster(frame, dims=2, levels=6).collect()
    assert len(rows) == len(points)
    found = defaultdict(set)
    for r in rows:
        found[r.topic].add(r.doc_id)
        assert (r.prob == 0) == (r.topic == -1) and r.prob <= 1
    noise = found.pop(-1, set())
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, plain_clusters(points, 6, 5)))
    sizes = [len(found[t]) for t in sorted(found)]
    assert sorted(found) == list(range(len(found))) and sizes == sorted(sizes, reverse=True)
    # The three planted groups come out, each almost pure.
    for low, high in ((0, 60), (60, 105), (105, 135)):
        best = max(found.values(), key=lambda m: len(m & set(range(low, high))))
        assert len(best & set(range(low, high))) > 0.8 * (high - low)
    assert noise


def test_equal_points_and_too_few_points(spark):
    frame = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(8)], "doc_id long, reduced array<double>")
    assert {r.topic for r in C.density_cluster(frame, dims=2, levels=3).collect()} == {-1}
    assert {r.topic for r in C.density_cluster(frame, dims=2, levels=3, allow_single=True).collect()} == {0}
    assert {r.topic for r in C.density_cluster(frame.limit(3), dims=2, levels=3, allow_single=True).collect()} == {-1}


def test_points_without_vector_are_outliers(spark):
    rows = [(i, list(p)) for i, p in enumerate(planted(0))] + [(1000, None)]
    found = C.density_cluster(spark.createDataFrame(rows, "doc_id long, reduced array<double>"), dims=2, levels=5)
    assert found.count() == len(rows)
    assert [(r.topic, r.prob) for r in found.where("doc_id = 1000").collect()] == [(-1, 0.0)]


def test_reduction_and_membership(spark):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 5), rng.gauss(0, 1), rng.gauss(0, 0.01)], i % 2 - 1) for i in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, embedding array<double>, topic int")
    reduced = C.reduce_dimensions(frame, 1)
    assert reduced.select(F.corr(F.col("reduced")[0], F.col("embedding")[0])).first()[0] ** 2 > 0.99
    probs = Counter()
    for r in C.membership_strength(frame).collect():
        assert 0 <= r.prob <= 1 + 1e-9 and (r.topic == 0 or r.prob == 0)
        probs[r.prob] += 1
    assert max(probs) > 1 - 1e-9
