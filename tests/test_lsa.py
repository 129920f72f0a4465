import numpy as np

from narrascope.operators import lsa


def docs(spark, seed=0, n=120, words=40):
    r = np.random.default_rng(seed)
    topics = r.dirichlet(np.full(words, 0.1), 6)
    rows = [(i, [f"w{w:02d}" for w in r.choice(words, r.integers(1, 60), p=topics[i % 6])]) for i in range(n)]
    return spark.createDataFrame([*rows, (500, []), (501, None), (502, ["unknown-word-of-one"])], "doc_id long, terms array<string>").repartition(4)


def dense(rows, features):
    a = np.zeros((len(rows), features))
    for i, r in enumerate(rows):
        a[i, r.places] = r.weights
    return a


def test_rows_are_tf_idf(spark):
    table = docs(spark)
    vocabulary = lsa.fit_vocabulary(table, features=20)
    words = {r.term: r for r in vocabulary.collect()}
    assert sorted(r.place for r in words.values()) == list(range(20))
    texts = {r.doc_id: r.terms for r in table.collect()}
    df = {w: sum(w in (t or []) for t in texts.values()) for w in words}
    assert [words_[0] for words_ in sorted(((w, df[w]) for w in words), key=lambda x: (-x[1], x[0]))] == sorted(words, key=lambda w: words[w].place)
    for r in lsa.term_rows(table, vocabulary).collect():
        want = {words[w].place: texts[r.doc_id].count(w) * (np.log((1 + len(texts)) / (1 + df[w])) + 1) for w in set(texts[r.doc_id]) & set(words)}
        assert dict(zip(r.places, map(lambda v: round(v, 9), r.weights))) == {p: round(v, 9) for p, v in want.items()}


def test_only_frequent_terms_are_counted(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(i, [f"w{w:02d}" for w in r.choice(40, 12)] + [f"rare-{i}-{k}" for k in range(40)]) for i in range(150)]
    table = spark.createDataFrame(rows, "doc_id long, terms array<string>").repartition(4)
    df = {}
    for _, terms in rows:
        for t in set(terms):
            df[t] = df.get(t, 0) + 1
    want = sorted(df, key=lambda t: (-df[t], t))
    for buckets, features in ((1 << 18, 10), (1 << 18, 60), (64, 10), (64, 5000), (1, 3)):
        monkeypatch.setattr(lsa, "BUCKETS", buckets)
        found = [v.term for v in sorted(lsa.fit_vocabulary(table, features=features).collect(), key=lambda v: v.place)]
        assert found == want[:features]
    monkeypatch.setattr(lsa, "BUCKETS", 1 << 18)
    assert lsa._frequent(table, "terms", 10).count() < 100
    # Unknown terms leave before the first shuffle.
    plan = lsa.term_rows(table, lsa.fit_vocabulary(table, features=10))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and all("hashpartitioning(doc_id" in line and "term" not in line for line in plan.split("\n") if "Exchange hash" in line)


def test_subspace_is_that_of_a_full_decomposition(spark):
    table = docs(spark)
    rows = lsa.term_rows(table, lsa.fit_vocabulary(table, features=60))
    a = dense(rows.collect(), 60)
    _, values, directions = np.linalg.svd(a, full_matrices=False)
    whole = lsa.fit_directions(rows, 60, k=8, more=60)
    assert np.allclose(whole.values, values[:8], rtol=1e-8)
    assert np.allclose(np.linalg.svd(directions[:8] @ whole.basis)[1], 1, atol=1e-8)
    # Fewer random columns than terms: the leading directions are still met.
    part = lsa.fit_directions(rows, 60, k=4, more=16)
    assert np.allclose(part.values[:3], values[:3], rtol=1e-2) and np.linalg.svd(directions[:3] @ part.basis)[1].min() > 0.99


def test_embedding_keeps_cosines_and_can_be_saved(spark, tmp_path):
    table = docs(spark)
    rows = lsa.term_rows(table, lsa.fit_vocabulary(table, features=60))
    found = lsa.fit_directions(rows, 60, k=60)
    found.save(spark, str(tmp_path / "m"))
    again = lsa.SingularDirections.load(spark, str(tmp_path / "m"))
    assert np.allclose(again.basis, found.basis) and np.allclose(again.values, found.values)
    kept = lsa.embed_rows(rows, again).collect()
    a = dense(kept, 60)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    e = np.array([r.embedding for r in kept])
    assert np.allclose(a @ a.T, e @ e.T, atol=1e-9)
