import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from narrascope.operators import packed as P
from narrascope.operators import topics as T


def test_blocks_give_back_their_rows():
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "", "a", "é x", f"word{rng.randrange(50)}", "long " * 20]), rng.randrange(-9, 9) ** 15,
             rng.choice([0.5, -0.0, 0.0, 2.25])) for _ in range(800)]
    table = pa.table({"topic": pa.array([r[0] for r in rows], pa.int32()), "term": [r[1] for r in rows], "n": [r[2] for r in rows], "w": [r[3] for r in rows]})
    blocks = [tuple(r[c] for c in ("kind", "n", "size", "block")) for b in P.pack(table, 3) for r in b.to_pylist()]
    for most in (10**9, 50):
        tables = [found[3] for found in P._tables(blocks, most)]
        assert sorted(str(r) for t in tables for r in zip(*(t.column(c).to_pylist() for c in ("topic", "term", "n", "w")))) == sorted(
            str(r) for r in rows if r[1] is not None)
        # All rows of a term are in one table.
        terms = [set(t.column("term").to_pylist()) for t in tables]
        assert sum(map(len, terms)) == len(set().union(*terms)) and (len(tables) > 5) == (most == 50)


def test_hashes_tell_where_terms_go():
    terms = pa.array([f"w{i} common tail" for i in range(5000)] + ["", "x"])
    found = P.term_hashes(terms)
    assert (found == P.term_hashes(pa.array(["skipped", *terms.to_pylist()]).slice(1))).all()
    assert np.bincount((found % np.uint64(16)).astype(int)).max() < 500


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    docs = [(rng.choice([1, 2, 3, 4, 5, 6, None]), rng.choice([-1, 0, 1, 2, None]), [rng.choice([*words, None, "rare"]) for _ in range(9)]) for _ in range(30)]
    docs += [docs[0], (7, 0, []), (8, 1, None), (9, 2, ["unknown"])]
    weights = [(t, w, math.log(2 + i), rng.random()) for t in (-1, 0, 1, 2) for i, w in enumerate(words) if rng.random() < 0.6]
    return (docs, weights, spark.createDataFrame(docs, "doc_id long, topic int, terms array<string>").repartition(3),
            spark.createDataFrame(weights, "topic int, term string, idf double, weight double"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_similarity_of_repeated_and_nameless_docs(tables, monkeypatch):
    docs, weights, frame, table = tables
    own = {(t, w): (idf, weight) for t, w, idf, weight in weights}
    dot, square, norm = defaultdict(float), defaultdict(float), defaultdict(float)
    for t, _, _, weight in weights:
        norm[t] += weight ** 2
    for doc, topic, terms in docs:
        for w, n in Counter(terms or []).items():
            if (topic, w) in own:
                idf, weight = own[topic, w]
                dot[doc, topic] += n * idf * weight
                square[doc, topic] += (n * idf) ** 2
    want = {k: round(v / math.sqrt(square[k] * norm[k[1]]), 6) for k, v in dot.items()}
    for most in (1 << 20, 4):
        monkeypatch.setattr(T, "SORTED_ROWS", most)
        found = T.doc_similarity(frame, table)
        # Terms of docs move in blocks, not as rows.
        assert "Generate" not in plan_of(found)
        assert {(r.doc_id, r.topic): round(r.similarity, 6) for r in found.collect()} == want


def test_assignment_of_repeated_docs(tables, monkeypatch):
    docs, weights, frame, table = tables
    norm, idfs = defaultdict(float), defaultdict(float)
    for t, w, idf, weight in weights:
        norm[t] += weight ** 2
        idfs[w] = max(idfs[w], idf)
    counts = defaultdict(Counter)
    for doc, _, terms in docs:
        counts[doc].update(w for w in terms or [] if w in idfs)
    want = Counter()
    for doc, _, _ in docs:
        dots = {t: sum(n * idf * weight / math.sqrt(norm[t]) for s, w, idf, weight in weights if s == t and (n := counts[doc][w])) for t in (0, 1, 2)}
        best = max(dots, key=lambda t: (dots[t], -t))
        length = math.sqrt(sum((n * idfs[w]) ** 2 for w, n in counts[doc].items()))
        want[(doc, best, round(dots[best] / length, 6)) if doc is not None and dots[best] else (doc, -1, 0.0)] += 1
    for settings in ({}, {"SORTED_ROWS": 4, "SUMS": 5, "PRODUCTS": 3}):
        for name, value in settings.items():
            monkeypatch.setattr(T, name, value)
        found = T.assign_by_terms(frame, table)
        assert "Generate" not in plan_of(found)
        assert Counter((r.doc_id, r.topic, round(r.similarity, 6)) for r in found.collect()) == want


def test_texts_of_chosen_docs_do_not_move(spark, tables):
    _, _, frame, table = tables
    docs = frame.selectExpr("doc_id", "topic", "terms", "array_join(terms, ' ') as text").where("doc_id is not null")
    found = T.with_text(T.representative_docs(docs, table), docs, "text")
    assert "SortMergeJoin" not in plan_of(found) and found.count() > 0
