import random

import pytest
from pyspark.sql import functions as F

from narrascope.operators import aggregates as A
from narrascope.operators import joins as J
from narrascope.operators import predicates as R
from narrascope.operators import sets as S
from narrascope.operators import windows as W
from narrascope.plans import flows


def test_text_column(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id int, ` Tweet ` string, text2 string")
    assert R.resolve_text_column(df) == " Tweet "
    assert R.rename_text(df).columns == ["id", "text", "text2"]
    with pytest.raises(ValueError):
        R.resolve_text_column(df.select("id"))


def test_null_tokens_and_projection(spark):
    df = spark.createDataFrame([("NA", "x"), ("n/a", ""), ("NAN", None)], "a string, b string").coalesce(1)
    assert [tuple(r) for r in R.fill_blank(R.null_tokens(df)).collect()] == [("", "x"), ("", ""), ("NAN", "")]
    assert R.project_output(df, ["b", "c", "b"]).columns == ["b", "c"]


def test_corpus_filters(spark):
    rows = [(1, "RT hello there", "en", "2022-01-01", 0, "false"), (2, "hello there", "EN", "2022-01-01", 3, "false"),
            (3, "hello there", "en", "2022-01-01", None, None), (4, "hello  there @you", "en", "2022-01-02", 0, "0"),
            (5, "other text", "en", "2022-01-01", 0, "True"), (6, "other text", "en", "nonsense", 0, None), (7, "four", "en", "2022-01-01", 0, None),
            (8, "fives", "en", "2022-01-01", 0, None), (9, "bonjour", "fr", "2022-01-01", 0, None), (10, None, "en", "2022-01-01", 0, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, language string, tweetcreatedts string, retweetco int, is_duplica string")
    assert sorted(r.doc_id for r in flows.prepare_corpus(df).collect()) == [3, 8]
    kept = flows.prepare_corpus(df, repost_mode="prefix")
    assert sorted(r.doc_id for r in kept.collect()) == [2, 8]


def test_keep_first_and_flags(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("aab") if i % 3 else "hot") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k string").repartition(7)
    seen, expected = set(), {}
    for i, k in rows:
        expected[i] = k in seen
        seen.add(k)
    assert {r.id: r.is_duplicate for r in W.flag_duplicates(df, "k", "id").collect()} == expected
    firsts = W.keep_first(df, "k", ["id"])
    assert sorted(r.id for r in firsts.collect()) == [i for i, flag in expected.items() if not flag]
    assert "WindowGroupLimit" in firsts._jdf.queryExecution().executedPlan().toString()
    assert not any(r.is_duplicate for r in W.flag_duplicates(df, "absent", "id").collect())
    two = W.flag_duplicates(df.withColumn("o", F.lit(1)), "k", ["o", "id"])
    assert {r.id: r.is_duplicate for r in two.collect()} == expected


def test_streaks_equal_a_plain_loop(spark):
    rng = random.Random(2)
    rows, expected, state = [], {}, {}
    for i in range(600):
        worker = "hot" if i % 3 else None if i % 2 else f"w{i % 5}"
        bad = rng.random() < 0.7
        rows.append((i, worker, i * 97, bad))
        state[worker] = state.get(worker, 0) + 1 if bad else 0
        expected[i] = (state[worker], state[worker] >= 4)
    df = spark.createDataFrame(rows, "id int, worker string, t int, bad boolean").repartition(5)
    for width in (50, 1000, 10 ** 9):
        out = W.failure_streak(df, "worker", ["t"], F.col("bad"), F.floor(F.col("t") / width), 4)
        assert {r.id: (r.streak, r.tripped) for r in out.collect()} == expected


def test_streaks_go_on_from_open_ones(spark):
    rows = [("a", 1, True), ("a", 2, True), ("a", 30, False), ("a", 31, True), ("b", 5, True), ("b", 25, True), ("c", 9, False)]
    df = spark.createDataFrame(rows, "w string, t int, bad boolean")
    opening = spark.createDataFrame([("a", 4), ("b", 1), ("c", 7), ("z", 2)], "w string, open long")
    options = (["t"], F.col("bad"), F.floor(F.col("t") / 10))
    out = W.failure_streak(df, "w", *options, 5, opening=opening)
    assert {(r.w, r.t): (r.streak, r.tripped) for r in out.collect()} == {
        ("a", 1): (5, True), ("a", 2): (6, True), ("a", 30): (0, False), ("a", 31): (1, False), ("b", 5): (2, False), ("b", 25): (3, False), ("c", 9): (0, False)}
    assert {r.w: r.open for r in W.open_streaks(df, "w", *options, opening).collect()} == {"a": 1, "b": 3, "c": 0, "z": 2}


def test_running_totals_and_numbering(spark):
    names = sorted(f"f{i}" for i in range(120))
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "file string, n int").repartition(4)
    out = {r.file: r.running_n for r in W.running_totals(df, "file", ["n"]).collect()}
    assert out == {n: sum(range(i + 1)) for i, n in enumerate(names)}
    sizes = spark.createDataFrame([(9, 5, 40), (3, 7, 10), (4, 5, 3), (-1, 50, 0), (8, 5, 2_000_000)], "cluster int, n int, min_id int")
    assert {r.cluster: r.topic for r in W.renumber_by_size(sizes).collect()} == {3: 0, 4: 1, 9: 2, 8: 3, -1: -1}


def test_probes(spark):
    ids = spark.createDataFrame([("1",), ("2",), ("3",), ("3",)], "id string")
    seen = spark.createDataFrame([("1",)], "id string")
    status = spark.createDataFrame([("2", 404, None), ("1", 404, None), ("9", None, "timeout")], "id string, status_code int, status_text string")
    plan, skipped = flows.fetch_plan(ids, seen, status)
    assert sorted(r.id for r in plan.collect()) == ["3", "3"]
    assert {r.id: r.reason for r in skipped.collect()} == {"1": "unavailable", "2": "unavailable"}
    assert sorted(r.id for r in J.anti_seen(ids, seen).collect()) == ["2", "3", "3"]
    assert sorted(r.id for r in S.difference_ids(ids, seen).collect()) == ["2", "3", "3"]
    assert tuple(A.status_buckets(status).first()) == (3, 0, 2, 0, 1, 0)


def test_counts_and_shares(spark):
    df = spark.createDataFrame([("en", ""), ("en", "deleted"), ("fr", None), ("", "deleted"), (None, "")], "language string, fail_reason string")
    assert [tuple(r) for r in A.value_counts(df, "language").collect()] == [("en", 2), ("fr", 1)]
    row = A.run_summary(df).first()
    assert row.language_counts == {"en": 2, "fr": 1} and row.summary == "Languages: {'en': 2, 'fr': 1} | Failures: {'deleted': 2}"
    labelled = spark.createDataFrame([(0, "a"), (0, "b"), (0, "a"), (-1, "c"), (1, None)], "topic int, label string")
    assert [tuple(r) for r in A.label_shares(labelled, "topic", "label", ["a", "b", "c"]).collect()] == [(-1, 0, 0, 1), (0, 2 / 3, 1 / 3, 0)]
    empty = A.run_tally(spark.createDataFrame([], "total long, matched long, duplicates long, multi_category long")).first()
    assert empty.match_rate == 0 and empty.match_rate_text == "0.00%"


def test_merge_and_declutter(spark):
    rows = [("'1", "keep", "", "7", 0), ("'1", "later", "", "7", 1), ("'2", "low", "", "2", 0), ("'3", "failed", "deleted", "7", 0),
            ("'4", "three", " ", "3", 0), ("'5", "odd", None, "x", 0)]
    df = spark.createDataFrame(rows, "tweet_id string, text string, fail_reason string, hydration_score string, shard int").withColumn("language", F.lit("en"))
    merged, summary = flows.merge_records(df, ["shard"])
    assert {r.tweet_id: r.text for r in merged.collect()} == {"'1": "keep", "'2": "", "'3": "", "'4": "three", "'5": ""}
    assert summary.first().language_counts == {"en": 5}
