import math
import re
from collections import Counter

import numpy as np

from narrascope.llm.toxic_neighbours import fit_toxicity, score_toxicity, text_terms, toxicity_query


def _dense(index, labelled):
    """Unit vectors of all sampled texts over all their terms, by loops over the definition."""
    counts = {(y, t): Counter(re.findall(r"[^\W_]+", t.lower())) for y, t in labelled}
    df = Counter(w for c in counts.values() for w in c)
    df1 = Counter(w for (y, _), c in counts.items() if y for w in c)
    n1, n = sum(y for y, _ in counts), len(counts)

    def weight(w):
        cells = [(df1[w], df[w] * n1), (df[w] - df1[w], df[w] * (n - n1)), (n1 - df1[w], (n - df[w]) * n1),
                 (n - n1 - df[w] + df1[w], (n - df[w]) * (n - n1))]
        lean = 2 * sum(seen * math.log(seen * n / expected) for seen, expected in cells if seen)
        return math.log1p(n / df[w]) * math.sqrt(max(lean, 0.0) + 0.1)

    def vector(count):
        held = {w: weight(w) * (1 + math.log(c)) for w, c in count.items() if w in df}
        length = math.sqrt(sum(v * v for v in held.values()))
        return {w: v / length for w, v in held.items()}

    return {key: vector(c) for key, c in counts.items() if c}, vector


def test_neighbours_are_the_exact_ones_over_all_terms(docs, labels, table):
    for block, k, light in ((4, 3, 0.5), (4, 3, 0.0), (64, 15, 0.02)):
        index = fit_toxicity(docs, labels, block=block)
        index.k, index.light, index.ahead = k, light, 2
        marks = {r.doc_id: r.toxic for r in labels.where("toxic is not null and doc_id is not null").collect()}
        examples, vector = _dense(index, {(marks[r[0]], r[1]) for r in table if marks.get(r[0]) is not None and r[1]})
        assert len(index.labels) == len(examples) and len(index.grams) == len({w for v in examples.values() for w in v})
        for row in table[:150]:
            asked = vector(Counter(re.findall(r"[^\W_]+", (row[1] or "").lower()))) if row[1] else {}
            cosines = sorted((sum(v * held.get(w, 0.0) for w, v in asked.items()) for held in examples.values()), reverse=True)
            found = [c for _, c in index.nearest(*index.vector(row[1]))] if asked else []
            assert np.allclose(found, [c for c in cosines if c > 1e-9][:k], atol=1e-5)


def test_an_insult_of_one_labelled_text_is_found(spark):
    plain = [f"word{i} other{i % 7} common the and" for i in range(60)]
    rows = [(i, t) for i, t in enumerate(plain)] + [(100, "the and you zzgrumpf common"), (101, "a zzgrumpf said so"), (102, "nothing said so")]
    marks = [(i, 0) for i in range(60)] + [(100, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = fit_toxicity(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    found = {r.doc_id: r.toxicity for r in score_toxicity(docs, index).collect()}
    assert found[100].score >= 0.5 and found[100].neighbours[0].label == 1
    assert found[101].neighbours[0].label == 1 and found[101].score > 10 * found[3].score
    assert not found[102].neighbours and found[102].score == index.prior


def test_terms_of_texts_in_pieces_and_of_scripts_without_blanks(monkeypatch):
    text = "One two, two_three! " * 50
    whole = text_terms(text)
    monkeypatch.setattr("narrascope.llm.toxic_neighbours.PIECE", 16)
    assert all(np.array_equal(a, b) for a, b in zip(whole, text_terms(text), strict=True))
    assert sorted(whole[1]) == [50, 50, 100]
    assert len(text_terms("\u4f60\u597d\u5417 ok \u597d")[0]) == 4 and not len(text_terms(" .,!\n")[0])


def test_toxic_texts_score_high_and_others_low(docs, labels):
    rows = {r.doc_id: r.toxicity for r in score_toxicity(docs, fit_toxicity(docs, labels)).collect()}
    assert all((rows[i].score >= 0.5) == (i % 10 == 0) for i in range(120))
    assert all(0 <= s.score < 0.3 and not s.neighbours for i, s in rows.items() if i in (200, 201, 202))
    assert rows[0].neighbours[0].label == 1 and 0 < rows[0].neighbours[0].cosine <= 1.001


def test_without_labels_or_rows(docs, no_docs, labels, table):
    rows = toxicity_query(docs, labels.limit(0)).collect()
    assert len(rows) == len(table) and {(r.score, r.predicted) for r in rows} == {(0.0, 0)}
    assert toxicity_query(no_docs, labels).count() == 0
    assert toxicity_query(docs, labels).count() == len(table)
