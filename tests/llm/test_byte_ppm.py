import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from narrascope.llm.byte_ppm import END, ORDER, START, Ppm, Table, fit_ppm, grams, ppm_query, train_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def padded(text):
    return bytes([START] * ORDER) + (text or "").translate(LOWER).encode() + bytes([END])


def plain_scorer(texts):
    """PPM of method C with exclusion, byte by byte."""
    seen = defaultdict(Counter)
    for text in texts:
        raw = padded(text)
        for i in range(ORDER, len(raw)):
            for k in range(ORDER + 1):
                seen[raw[i - k:i]][raw[i]] += 1

    def prob(context, byte):
        excluded, p = set(), 1.0
        for k in range(len(context), -1, -1):
            found = {b: n for b, n in seen.get(context[len(context) - k:], {}).items()}
            if not found:
                continue
            left = {b: n for b, n in found.items() if b not in excluded}
            total, escape = sum(left.values()), len(left)
            if byte in left:
                return p * left[byte] / (total + escape)
            if escape:
                p *= escape / (total + escape)
            excluded |= set(found)
        return p / (256 - len(excluded))

    return prob, lambda text: sum(math.log10(prob(padded(text)[i - ORDER:i], padded(text)[i])) for i in range(ORDER, len(padded(text))))


def test_scores_equal_the_plain_ones(docs, table):
    texts = [r[1] for r in table if r[0] is not None and r[0] < 60]
    counts, _ = train_counts(docs.where("doc_id < 60"))
    # Repeated rows count as often as they stand there.
    ppm, (prob, score) = fit_ppm(counts), plain_scorer(texts)
    for text in ["", "the thing", "zzz unseen £ ü", table[70][1], table[2][1]]:
        assert ppm.score(text) == pytest.approx(score(text), rel=1e-9)
    context = padded("the")[-1 - ORDER:-1]
    assert sum(prob(context, b) for b in range(256)) == pytest.approx(1)


def test_no_training_and_pieces(monkeypatch):
    import narrascope.llm.byte_ppm as module

    assert Ppm([]).score("ab") == pytest.approx(3 * -math.log10(256))
    whole = np.concatenate(list(grams("some text " * 40)))
    monkeypatch.setattr(module, "PIECE", 13)
    assert (np.concatenate(list(grams("some text " * 40))) == whole).all()


def test_table_finds_all_keys():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64))
    table = Table(keys)
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert (Table(keys[:0]).find(keys[:3]) == -1).all()


def test_base_score_and_counts(docs, table, no_docs, monkeypatch):
    import narrascope.llm.byte_ppm as module

    # So small that most words go by way of the join.
    monkeypatch.setattr(module, "HEAD", 20)
    tokens = [(r[0], [*re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(LOWER)), None]) for r in table]
    train = [t for d, t in tokens if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1]
    counts = Counter(w for t in train for w in t)
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((str(d), len(t), sum(counts[w] > 0 for w in t), total,
                   round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t), 4)) for d, t in tokens)
    rows = ppm_query(docs).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
    assert all(r.score < 0 for r in rows) and ppm_query(no_docs).count() == 0
    nothing = ppm_query(docs.where("doc_id is null").withColumn("doc_id", F.lit(5))).first()
    assert nothing.train_tokens in (0, nothing.n_tokens)


def test_rare_grams_count_in_a_corpus_of_over_two_megabytes(spark, monkeypatch):
    import narrascope.llm.byte_ppm as module

    monkeypatch.setattr(module, "GATHER", 50)
    texts = ["the cat sat on the mat and ate " * 900] * 80 + ["the quick zebra saw a yak", "quick quartz"]
    asked = ["quick zebra", "the quiet zebras", "quartz ü", "", None]
    rows = [(i, t, True) for i, t in enumerate(texts)] + [(1000 + i, t, False) for i, t in enumerate(asked)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    found = {r.doc_id: r.score for r in module.score_documents(frame, F.col("train")).collect()}
    _, score = plain_scorer(texts)
    for i, text in [(80, texts[80]), (81, texts[81]), *((1000 + i, t) for i, t in enumerate(asked))]:
        assert found[i] == pytest.approx(score(text), rel=1e-9)
