import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from narrascope.llm.line_dedup import DROP, OPEN, FirstDocuments, keep_lines, line_bitmaps, line_dedup_query

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOWER)


def plain(rows, least=10):
    """(doc_id, n_lines, n_dropped, text kept) of each row, by a dictionary of all lines."""
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= least:
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(key(x)) < least or doc == min(holders[key(x)])]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.fixture(scope="module")
def rows(table):
    r = random.Random(8)
    pool = [" ".join(r.choice("alpha beta gamma delta Öl 語".split()) for _ in range(r.randint(1, 6))) for _ in range(80)]
    made = [(r.randint(1000, 1120), "\n".join(r.choice([" ", "", "\t"]) + r.choice(pool).swapcase() + r.choice(["", "\r", " "])
                                              for _ in range(r.randint(1, 12)))) for _ in range(150)]
    # One line in a third of all rows, texts of equal ids, texts that lose every line, exact copies.
    made += [(2000 + i, f"a very common line here\nonly this one {i}") for i in range(120)]
    made += [(3000 + i, "a very common line here") for i in range(5)] + [(3000, "other text of the id\na very common line here")] * 3
    made += [(None, "a very common line here"), (None, None), (5, "語" * 9), (6, "語" * 9), (7, "語" * 10), (8, " " + "語" * 10 + "\n"),
             (9, "\n\n"), (10, " a very common line here"), (-4, "A VERY common line here")]
    return [(x[0], x[1]) for x in table] + made


def check(docs, rows):
    want = Counter((d, n, gone, hashlib.sha256(t.encode()).hexdigest()) for d, n, gone, t in plain(rows))
    assert Counter(tuple(r) for r in line_dedup_query(docs).collect()) == want


def test_against_a_dictionary(spark, rows):
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_one_line_over_many_ranges(spark, rows):
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_columns_stay_and_texts_come_back(spark, rows):
    docs = spark.createDataFrame([(d, t, 1, "r", "k") for d, t in rows], "doc_id long, text string, lines int, row string, keep string")
    found = keep_lines(docs, line_bitmaps(docs))
    assert sorted(found.columns) == sorted(docs.columns)
    assert Counter((r.doc_id, r.lines.n_lines, r.lines.n_dropped, r.lines.kept) for r in found.collect()) == Counter(plain(rows))
    few = line_bitmaps(docs, least_chars=3)
    assert Counter((r.doc_id, r.lines.kept) for r in keep_lines(docs, few).collect()) == Counter((d, t) for d, _, _, t in plain(rows, 3))


def test_no_rows(no_docs):
    assert line_dedup_query(no_docs).count() == 0


def test_streaming_in_any_batches():
    r = np.random.default_rng(0)
    for _ in range(60):
        n = int(r.integers(1, 30))
        hi, lo, doc = r.integers(0, 4, n), r.integers(0, 2, n), r.integers(0, 6, n)
        order = np.lexsort((doc, lo, hi))
        hi, lo, doc = hi[order], lo[order], doc[order]
        state, seen = FirstDocuments(), []
        cuts = [0, *sorted(r.integers(0, n + 1, 3)), n]
        for a, b in zip(cuts, cuts[1:]):
            found, kind = state.feed(hi[a:b], lo[a:b], doc[a:b])
            seen += [(a + int(i), int(k)) for i, k in zip(found, kind)]
        head = (hi[0], lo[0])
        want = []
        for i in range(n):
            own = (hi == hi[i]) & (lo == lo[i])
            if (hi[i], lo[i]) == head:
                want.append((i, OPEN))
            elif doc[i] != doc[own].min():
                want.append((i, DROP))
        assert seen == want
        last = (hi == hi[-1]) & (lo == lo[-1])
        assert state.close() == [(*head, doc[(hi == head[0]) & (lo == head[1])].min()), (hi[-1], lo[-1], doc[last].min())]
    assert FirstDocuments().close() == []
