import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from narrascope.operators import topics as T
from narrascope.plans import flows

WORDS = {-1: "misc other random noise aid".split(), 0: "red cross aid people war".split(), 1: "agency russia house park flowers".split(),
         2: "agency people flowers red noise".split(), 3: "house cross park war misc".split()}
STOP = ("the", "a", "of")


def make_docs(n=150):
    rng = random.Random(4)
    start = datetime(2022, 1, 1, tzinfo=timezone.utc)
    rows = []
    for i in range(n):
        topic = rng.choice([-1, 0, 0, 1, 2, 3])
        text = " ".join(rng.choice(WORDS[topic] + ["the", "ukraine", "help", "of"]) for _ in range(12)) + f" unique{i}"
        rows.append((i, topic, text, start + timedelta(hours=7 * i)))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(make_docs(), "doc_id long, topic int, clean_text string, ts timestamp")
    return T.tokenise_ngrams(frame, "clean_text", STOP)


def brute_weights():
    counts = defaultdict(Counter)
    for _, topic, text, _ in make_docs():
        tokens = [w for w in text.split() if w not in STOP]
        counts[topic].update(tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])])
    df = Counter(t for c in counts.values() for t in c)
    kept = {t for t, n in df.items() if 2 <= n <= 0.95 * len(counts)}
    f = Counter()
    for c in counts.values():
        f.update({t: n for t, n in c.items() if t in kept})
    size = {k: sum(n for t, n in c.items() if t in kept) for k, c in counts.items()}
    mean = int(sum(size.values()) / len(size))
    return {(k, t): n / size[k] * math.log(1 + mean / f[t]) for k, c in counts.items() for t, n in c.items() if t in kept}


def test_weights_equal_brute_force(docs):
    got = {(r.topic, r.term): r.weight for r in T.ctfidf(T.class_term_frequency(docs)).collect()}
    expected = brute_weights()
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-12 for k in got)


def test_tables_keep_the_invariants(spark, docs):
    labels = ["LABEL_0", "LABEL_1", "LABEL_2"]
    sentiment = F.element_at(F.array(*[F.lit(v) for v in labels]), (F.col("doc_id") % 3 + 1).cast("int"))
    tables = flows.narrative_tables(docs.drop("terms"), "ts", STOP, lambda d: d.withColumn("sentiment", sentiment))
    info = {r.topic: r for r in tables["topic_info"].collect()}
    size = Counter(t for _, t, _, _ in make_docs())
    assert {t: r["count"] for t, r in info.items()} == size and list(info) == sorted(info)
    for topic, row in info.items():
        assert len(row.representation) == 10 and row.name == "_".join([str(topic), *row.representation[:4]])
        assert len(row.representative_docs) == 3
    ranks = defaultdict(list)
    for r in tables["topic_representative_docs"].collect():
        ranks[r.topic].append(r["rank"])
    assert {t: sorted(v) for t, v in ranks.items()} == {t: [1, 2, 3] for t in size}
    cells = tables["topics_over_time"].collect()
    total = Counter()
    for r in cells:
        assert r.frequency > 0 and len(r.words) == 5 and 0 <= r.bin < 5
        total[r.topic] += r.frequency
    assert total == size
    for r in tables["sentiment_by_topic"].collect():
        assert abs(sum(r[1:]) - 1) < 1e-9
    assert {r.prob for r in tables["posts_with_topics"].where("topic = -1").collect()} == {0.0}


def test_time_blending(spark, docs):
    weights = T.ctfidf(T.class_term_frequency(docs))
    binned = T.add_time_bin(docs, "ts")
    plain = {(r.topic, r.bin, r.term): r.weight for r in T.bin_weights(binned, weights, False, False).collect()}
    blended = {(r.topic, r.bin, r.term): r.weight for r in T.bin_weights(binned, weights, True, False).collect()}
    cells = {k[:2] for k in plain}
    for (topic, b, term), weight in blended.items():
        own, before = plain.get((topic, b, term), 0), plain.get((topic, b - 1, term), 0)
        assert abs(weight - ((own + before) / 2 if (topic, b - 1) in cells else own)) < 1e-12
    for keys in cells:
        assert abs(sum(w for k, w in blended.items() if k[:2] == keys) - 1) < 1e-9


def test_model_round_trip_and_assignment(spark, docs, tmp_path):
    weights = T.ctfidf(T.class_term_frequency(docs))
    flows.save_topic_model(weights, str(tmp_path / "model"))
    loaded = flows.load_topic_weights(spark, str(tmp_path / "model"))
    new = spark.createDataFrame([(1, "red cross aid for people"), (2, "flowers in the park house"), (3, "nothing known")], "doc_id long, clean_text string")
    out = {r.doc_id: r.topic for r in T.assign_by_terms(T.tokenise_ngrams(new, "clean_text", STOP), loaded).collect()}
    assert (out[1], out[2], out[3]) == (0, 1, -1)


def test_chunks_add_up_to_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 5)
    monkeypatch.setattr(T, "READ_ROWS", 2)
    rows = [(1, ["a", "b", "a"]), (None, ["a"]), (2, None), (2, []), (1, ["a", "é", None]), (2, ["b"]), (1, ["a", "b", "a"])]
    docs = spark.createDataFrame(rows, "topic int, terms array<string>").coalesce(1)
    assert T.partial_counts(docs).count() > len({(t, w) for t, ws in rows for w in ws or [] if w})
    plain = Counter((t, w) for t, ws in rows for w in ws or [] if w)
    assert {(r.topic, r.term): r.n for r in T.class_term_frequency(docs).collect()} == plain


def test_spread_in_small_tables_keeps_topics_of_rare_terms(spark, monkeypatch):
    monkeypatch.setattr(T, "SORTED_ROWS", 3)
    rows = [(t, f"w{i}", 1) for i in range(40) for t in range(i % 4)] * 2 + [(9, "only here", 5)]
    counts = spark.createDataFrame(rows, "topic int, term string, n long")
    spread = T.spread_of_terms(counts)
    got = {(r.topic, r.term): (r.n, r.df, r.f) for r in spread.where("term is not null").collect()}
    assert got == {(t, f"w{i}"): (2, i % 4, 2 * (i % 4)) for i in range(40) if i % 4 >= 2 for t in range(i % 4)}
    assert {r.topic for r in spread.select("topic").collect()} == {0, 1, 2, 9}
    assert {(r.term, r.df, r.f) for r in T.prune_vocabulary(counts).collect()} == {(f"w{i}", i % 4, 2 * (i % 4)) for i in range(40) if i % 4 >= 2}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_are_not_exploded(docs):
    assert "Generate" not in plan_of(T.class_term_frequency(docs))


def test_bins_carry_what_the_next_one_lacks(spark, monkeypatch):
    monkeypatch.setattr(T, "SORTED_ROWS", 2)
    rows = [(0, 0, ["a", "a", "b"]), (0, 1, ["b"]), (0, 3, ["a", "new"]), (1, 0, ["a"]), (None, 0, ["a"])]
    binned = spark.createDataFrame(rows, "topic int, bin int, terms array<string>")
    weights = spark.createDataFrame([(0, "a", 1.0, 3.0), (0, "b", 2.0, 1.0), (1, "a", 1.0, 5.0)], "topic int, term string, idf double, weight double")
    got = {(r.topic, r.bin, r.term): round(r.weight, 9) for r in T.bin_weights(binned, weights, True, True, k=1).collect()}
    # Shares of bin 0 are a 1/2, b 1/2; over all time a 3/4, b 1/4. Bin 3 follows none; its term b is not listed.
    assert got == {(0, 0, "a"): 0.625, (0, 0, "b"): 0.375, (0, 1, "a"): 0.5, (0, 1, "b"): 0.5, (0, 3, "a"): 0.875, (1, 0, "a"): 1.0}


def test_terms_of_a_row_are_sorted_without_comparator(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "b", "é", "b a"]), (2, []), (3, None)], "doc_id long, terms array<string>")
    counted = T.count_in_row(docs, "terms", "doc_id")
    assert sorted(tuple(r) for r in counted.collect()) == [(1, "a", 1), (1, "b", 2), (1, "b a", 1), (1, "é", 1)]
    assert "array_sort" not in counted._jdf.queryExecution().optimizedPlan().toString()
