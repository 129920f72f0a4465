import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from narrascope.llm.source_mix import MIX_SQL, mix_query, mix_sources, mixed_documents, schedule, targets


def plain_targets(sizes):
    """Targets by handing on the excess until none is above its bound."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        found = {s: 3.0 * sizes[s] if s in full else weight[s] * rest / share for s in names}
        over = {s for s in names if s not in full and found[s] > 3 * sizes[s]}
        if not over:
            return found
        full |= over


def test_against_sql_and_plain_targets(docs, table):
    # Repeated rows are told apart by nothing, so SQL may deal their words the other way round.
    rows = list(dict.fromkeys(table))
    frame = docs.sparkSession.createDataFrame(rows, docs.schema)
    found = [tuple(r) for r in mix_query(frame).collect()]
    con = duckdb.connect()
    documents = frame.select("doc_id", "text", "source").toPandas()  # noqa: F841
    con.execute("create table documents as select try_cast(doc_id as bigint) as doc_id, text, source from documents")
    assert sorted(map(str, found)) == sorted(str(tuple(r)) for r in con.execute(MIX_SQL).fetchall())
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = plain_targets(sizes)
    taken = Counter()
    for r in mix_sources(frame).collect():
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_repeated_rows_and_reruns(docs, table):
    first = sorted(map(str, mix_query(docs).collect()))
    assert len(first) == len(table) and first == sorted(map(str, mix_query(docs.repartition(7)).collect()))


def test_small_sources_and_excess(spark):
    sizes = [("a", 1), ("b", 30_000), ("c", 5), ("d", 0), (None, 7000), ("e", 100)]
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate(sizes)]
    found = {r.source: r for r in mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    want = plain_targets(dict(sizes))
    assert all(abs(found[s].taken - want[s]) <= 0.5 and found[s].taken <= 3 * n for s, n in sizes)


def test_every_stretch_of_the_schedule_is_near_the_weights(spark):
    sources = targets(spark.createDataFrame([("a", 400_000), ("b", 300_000), ("c", 300_000)], "source string, source_size long"))
    sources = sources.withColumn("goal", F.round("target").cast("long")).withColumn("slots", F.ceil(F.col("target") / 500)).cache()
    rows = schedule(sources, 500).collect()
    assert sorted(r.slot for r in rows)[:1000] == list(range(1000))
    order = [r.sid for r in sorted(rows, key=lambda r: r.slot)]
    for at in range(0, len(order) - 200, 50):
        part = Counter(order[at:at + 200])
        assert all(abs(part[i] - 200 * w / 8) <= 4 for i, w in enumerate((5, 2, 1)))
    for sid in range(3):
        ranks = [r.rank for r in sorted(rows, key=lambda r: r.slot) if r.sid == sid]
        assert ranks == list(range(len(ranks)))


def test_no_rows_and_no_words(docs, no_docs):
    assert mix_query(no_docs).count() == 0
    empty = mix_query(docs.where("doc_id in (200, 201, 202)")).collect()
    assert {(r.size, r.target, r.taken) for r in empty} == {(0, 0.0, 0)}


def test_documents_come_as_often_as_they_are_taken(docs, table):
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in mix_sources(docs).collect():
        want[(r.doc_id, r.source)] += -(-r.taken // r.size) if r.size else 0
    assert Counter((r.doc_id, r.source) for r in mixed.collect()) == +want


def test_words_of_whole_documents_meet_the_targets(spark):
    r, rows = random.Random(6), []
    for source, count in (("a", 120), ("b", 150), ("c", 150), (None, 40)):
        rows += [(len(rows) + i, "w " * r.choice([3, 40, 300, 1500, 2500]), source) for i in range(count)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes, longest, emitted = defaultdict(int), defaultdict(int), Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
        longest[source] = max(longest[source], len(text.split()))
    texts = {i: text for i, text, _ in rows}
    for row in mixed_documents(frame).collect():
        assert row.text == texts[row.doc_id]
        emitted[row.source] += len(row.text.split())
    want = plain_targets(sizes)
    assert all(abs(emitted[s] - want[s]) <= longest[s] / 2 + 1 for s in want)


def test_points_give_the_order_of_the_mix_but_not_its_sums(spark, monkeypatch):
    import narrascope.llm.source_mix as module

    docs = spark.createDataFrame([(i, "w " * (20 + 7 * (i % 11)), f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    taken = {r.doc_id: r.taken for r in module.mix_sources(docs, block_words=64).collect()}

    def mixed():
        rows = module.mixed_blocks(docs, block_words=64).collect()
        sums, per_slot = Counter(), {}
        for r in rows:
            sums[r.doc_id] += r.words
            per_slot.setdefault(r.slot, set()).add(r.source)
            assert 0 <= r.start and r.start + r.words <= 20 + 7 * (r.doc_id % 11)
        assert all(len(s) == 1 for s in per_slot.values())
        return sums, [next(iter(per_slot[s])) for s in sorted(per_slot)]

    sums, order = mixed()
    assert {d: n for d, n in taken.items() if n} == dict(sums)
    # Each stretch of 40 slots is near the shares of the whole.
    whole = Counter(order)
    for at in range(0, len(order) - 40, 40):
        part = Counter(order[at:at + 40])
        assert all(abs(part[s] - 40 * n / len(order)) <= 6 for s, n in whole.items())
    monkeypatch.setattr(module, "GOLDEN", 1640531527)
    other_sums, other = mixed()
    assert other_sums == sums and other != order and Counter(other) == whole


def test_documents_come_in_the_order_of_the_schedule(spark, monkeypatch):
    import narrascope.llm.source_mix as module

    r = random.Random(9)
    texts = {i: "w " * r.choice([3, 20, 45, 90]) for i in range(900)}
    rows = [(i, t, (None, "a", "b")[i % 3]) for i, t in texts.items()]
    docs = spark.createDataFrame([*rows, rows[4], rows[4]], "doc_id long, text string, source string")
    sizes = Counter()
    for _, text, source in [*rows, rows[4], rows[4]]:
        sizes[source] += len(text.split())
    want = plain_targets(sizes)

    def mixed():
        out = [(x.doc_id, x.source) for x in module.mixed_documents(docs, block_words=64).collect()]
        words = Counter()
        for i, source in out:
            words[source] += len(texts[i].split())
        assert all(abs(words[s] - want[s]) <= 46 for s in want)
        return out, words

    order, words = mixed()
    whole = sum(words.values())
    for at in range(0, len(order) - 200, 50):
        part = Counter()
        for i, source in order[at:at + 200]:
            part[source] += len(texts[i].split())
        assert all(abs(part[s] / sum(part.values()) - words[s] / whole) <= 0.12 for s in words)
    assert mixed()[0] == order
    # Other points give another order of the same rows, another step other rows.
    with monkeypatch.context() as m:
        m.setattr(module, "GOLDEN", 1640531527)
        other, _ = mixed()
        assert other != order and Counter(other) == Counter(order)
    monkeypatch.setattr(module, "STEP", 1000003)
    assert Counter(mixed()[0]) != Counter(order)
