import math

import numpy as np
import pytest

import narrascope.operators.neighbours as N

SCHEMA = "vec_id long, embedding array<double>"


def table(spark, seed=0, n=400, dims=12):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(25, dims))
    x = centers[r.integers(0, 25, n)] + r.normal(size=(n, dims)) * r.choice([0.1, 0.4, 1.0], (n, 1))
    rows = [(int(i), list(map(float, v))) for i, v in enumerate(x)]
    rows += [(1000, rows[5][1]), (1001, rows[5][1]), (1002, None), (1003, []), (1004, [0.0] * dims), (1005, [float("nan")] * dims),
             (1006, [None] * dims), (None, rows[1][1]), (1007, [1.0, 2.0]), (1008, [2.0, 4.1]), (1009, [2 * v for v in rows[7][1]])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows


def plain(rows, least):
    least_id = {}
    for i, x in rows:
        if i is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x):
            least_id[tuple(x)] = min(i, least_id.get(tuple(x), i))
    units = [(i, np.array(x) / np.linalg.norm(x)) for x, i in least_id.items()]
    return {(min(i, j), max(i, j)): float(u @ v) for k, (i, u) in enumerate(units) for j, v in units[:k] if len(u) == len(v) and u @ v >= least}


@pytest.mark.parametrize("least", [0.5, 0.8, 0.97])
def test_exact_pairs(spark, least, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 30)
    df, rows = table(spark)
    found = N.near_pairs_exact(df, least).collect()
    want = plain(rows, least)
    assert len(found) == len(want) and {(r.a, r.b) for r in found} == set(want)
    assert all(abs(r.cosine - want[r.a, r.b]) < 1e-9 for r in found)


def test_recall_of_random_projections_and_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 30)
    df, rows = table(spark, 1)
    for least in (0.8, 0.95):
        found = N.near_pairs(df, least, bits=6).collect()
        want = plain(rows, least)
        pairs = [(r.a, r.b) for r in found]
        assert len(set(pairs)) == len(pairs) and set(pairs) <= set(want)
        assert len(pairs) >= 0.9 * len(want) > 50
    assert N.pair_recall(N.near_pairs(df, 0.95, bits=6), N.near_pairs_exact(df, 0.95)) >= 0.9


def written_rows(monkeypatch):
    rows, write = [], N.cut_lineage
    monkeypatch.setattr(N, "cut_lineage", lambda df: [rows.append(df.count()), write(df)][1])
    return rows


def test_exact_search_writes_no_copies_of_vectors(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 150)
    df, rows = table(spark)
    written = written_rows(monkeypatch)
    found = N.near_pairs_exact(df, 0.5)
    assert max(written) <= len(rows)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in text and "Generate" not in text
    assert {(r.a, r.b) for r in found.collect()} == set(plain(rows, 0.5))


def test_projected_search_writes_each_vector_once_and_takes_whole_buckets(spark, monkeypatch):
    df, rows = table(spark, 1)
    written = written_rows(monkeypatch)
    dealt, real = [], N.block_pairs
    monkeypatch.setattr(N, "block_pairs", lambda d, *a: [dealt.append(real(d, *a)), dealt[-1]][1])
    N.near_pairs(df, 0.8, bits=1)
    assert max(written) <= len(rows)
    vectors = len({x for _, x in ((i, tuple(x or ())) for i, x in rows)})
    assert dealt[0].count() <= vectors * N.tables_for(0.8, 1, 0.95)


def test_copies_stand_as_one(spark):
    df, rows = table(spark)
    reps = {}
    for r in N.representatives(df).collect():
        reps.setdefault(r.id, set()).add(r.rep)
    assert reps[1000] == reps[1001] == {5} and reps[6] == {6} and not {1002, 1003, 1004, 1005, 1006} & set(reps)


def test_tables_follow_from_the_recall():
    assert N.tables_for(1.0, 8, 0.99) == 1
    for least, bits in ((0.9, 10), (0.5, 6)):
        n, share = N.tables_for(least, bits, 0.95), N.share_of_tables(least, bits)
        assert 1 - (1 - share) ** n >= 0.95 > 1 - (1 - share) ** (n - 1)


def test_no_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert N.near_pairs(empty, 0.9).count() == 0 and N.near_pairs_exact(empty, 0.9).count() == 0
