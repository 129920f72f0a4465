import math
from collections import Counter

import numpy as np

from narrascope.llm.language_codes import codewords, fit_languages, identify_languages, language_query, pieces


def test_codewords_lie_apart():
    for classes in (2, 3, 4, 7, 12):
        code = codewords(classes).astype(int)
        apart = (code.shape[1] - code @ code.T) // 2
        assert code.shape[0] == classes and apart[~np.eye(classes, dtype=bool)].min() >= max(1, code.shape[1] // 5)
        assert (abs(code.sum(0)) < classes).all() or classes == 1


def test_pieces_of_a_long_text_hold_every_gram(monkeypatch):
    import narrascope.llm.language_codes as module

    text = "the quick brown fox, " * 30
    whole = np.sort(np.concatenate(list(pieces(text))))
    monkeypatch.setattr(module, "PIECE", 17)
    assert (np.sort(np.concatenate(list(pieces(text)))) == whole).all()


def test_languages_are_told_apart(spark, docs):
    train = docs.where("doc_id % 2 = 0")
    model = fit_languages(train)
    assert model.languages == ["de", "en", "fr"]
    found = {r.doc_id: r for r in identify_languages(docs, model).select("doc_id", "lang", "score", "language.*").toDF(
        "doc_id", "lang", "own", "lang_pred", "score", "ambiguous", "gap").collect()}
    held = [r for i, r in found.items() if i is not None and i < 120 and i % 2]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    for i in (200, 201, 202, 203):
        assert found[i].lang_pred == "und" and found[i].score == 0
    assert found[204].lang_pred == "en" and all(0 <= r.score <= 1 for r in found.values())


def test_fewer_than_two_languages_and_no_rows(spark, docs, no_docs):
    one = fit_languages(docs.where("lang = 'en'"))
    assert one.predict("une phrase")[:2] == ("en", 1.0)
    assert fit_languages(no_docs).predict("words")[0] == "und"
    assert language_query(no_docs).count() == 0


def test_query_columns_and_rows(docs, table):
    rows = language_query(docs).collect()
    assert len(rows) == len(table) and rows[0].asDict().keys() >= {"doc_id", "held_out", "lang_pred", "score"}


def test_counts_weights_and_decoding_against_loops(spark, docs, table):
    model = fit_languages(docs.where("doc_id % 2 = 0"))
    texts = {(r[2], r[1]) for r in table if r[0] is not None and r[0] % 2 == 0 and r[1] is not None and r[2] is not None}
    languages = sorted({lang for lang, _ in texts})
    slots = len(model.weights)
    counts = {lang: Counter() for lang in languages}
    for lang, text in texts:
        for part in pieces(text):
            counts[lang].update(part.tolist())
    code = codewords(len(languages)).astype(int)
    rate = lambda lang, slot: (counts[lang][slot] + 0.5) / (sum(counts[lang].values()) + 0.5 * slots)
    seen = sorted(set().union(*counts.values()))
    for slot in [*seen[::37], *(s for s in range(0, slots, slots // 7) if s not in set(seen))]:
        for b in range(code.shape[1]):
            ahead = [rate(x, slot) for x, c in zip(languages, code[:, b]) if c > 0]
            behind = [rate(x, slot) for x, c in zip(languages, code[:, b]) if c < 0]
            want = math.log(sum(ahead) / len(ahead)) - math.log(sum(behind) / len(behind))
            assert abs(model.weights[slot, b] - want) < 1e-4

    def margins(text):
        own = [s for part in pieces(text) for s in part.tolist()]
        return [sum(float(model.weights[s, b]) for s in own) / len(own) for b in range(code.shape[1])] if own else None

    # How often each bit is right for a language, smoothed, as shares of its bits.
    for i, lang in enumerate(languages):
        known = [m for x, t in texts if x == lang and (m := margins(t)) is not None]
        right = [(sum(m[b] * code[i, b] > 0 for m in known) + 0.5) / (len(known) + 1) for b in range(code.shape[1])]
        assert np.allclose(model.trust[i], np.array(right) / sum(right), atol=1e-6)

    for _, text, *_ in table[:40:7]:
        m = margins(text)
        loss = [sum(model.trust[i, b] * math.log(1 + math.exp(-model.slope * code[i, b] * m[b])) for b in range(code.shape[1])) for i in range(len(languages))]
        best = min(range(len(languages)), key=lambda i: loss[i])
        lang, score, ambiguous, gap = model.predict(text)
        assert lang == languages[best] and abs(gap - (sorted(loss)[1] - sorted(loss)[0])) < 1e-5
        assert abs(score - 1 / sum(math.exp(-model.sharpness * (x - loss[best])) for x in loss)) < 1e-5 and ambiguous == (gap < model.least_gap)
