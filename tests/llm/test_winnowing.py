import hashlib
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from narrascope.llm.winnowing import PLACE, UNITS, fingerprint, fingerprint_query, with_next

xxhash = pytest.importorskip("xxhash")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain(text, k=4, w=8):
    """Least hash of each window, the rightmost of equal ones, with its position."""
    runs = [signed(xxhash.xxh64(x.encode(), 42).intdigest()) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]

    def pair(a, b):
        return signed(xxhash.xxh64(struct.pack("<q", b), xxhash.xxh64(struct.pack("<q", a), 42).intdigest()).intdigest())

    if not runs:
        return []
    if len(runs) < k:
        runs = [signed(xxhash.xxh64(" ".join(map(str, runs)).encode(), 42).intdigest())]
    else:
        step = 1
        while step < k:
            runs, step = [pair(a, b) for a, b in zip(runs, runs[step:])], step * 2
    runs = [x % (1 << 32) for x in runs]
    found = []
    for i in range(max(1, len(runs) - w + 1)):
        part = runs[i:i + w]
        place = max(j for j, x in enumerate(part) if x == min(part))
        if (part[place], i + place) not in found:
            found.append((part[place], i + place))
    return found


def test_fingerprints_equal_the_plain_ones(docs):
    for r in docs.select("text", fingerprint(F.col("text")).alias("f")).where("text is null or length(text) < 5000").collect():
        assert [(x >> 31, PLACE - (x & PLACE)) for x in r.f] == plain(r.text)


def test_shared_run_is_found(spark):
    shared = " ".join(f"s{i}" for i in range(11))
    rows = [(i, " ".join(f"a{i}x{j}" for j in range(i)) + " " + shared + " " + " ".join(f"b{i}x{j}" for j in range(30 - i)))
            for i in range(20)]
    prints = [{x >> 31 for x in r.f} for r in spark.createDataFrame(rows, "id long, text string").select(
        fingerprint(F.col("text")).alias("f")).collect()]
    assert all(a & b for a in prints for b in prints)


def test_next_row_over_pieces(spark, no_docs):
    rows = [(i * 7 % 101, f"t{i}") for i in range(101)] + [(None, "n"), (None, "m"), (50, "again"), (50, "again")]
    found = with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "doc_id", ["text"], 10).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = sorted((str(a), b, order[(i + 1) % len(order)][1]) for i, (a, b) in enumerate(order))
    assert sorted((str(r.doc_id), r.text, r.next_text) for r in found) == want
    assert with_next(no_docs, "doc_id", ["text"]).count() == 0


def test_query(docs, table, no_docs):
    rows = fingerprint_query(docs).collect()
    assert len(rows) == len(table) and fingerprint_query(no_docs).count() == 0
    order = sorted(((r[0], r[1] or "") for r in table), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = set()
    for i, (doc, text) in enumerate(order):
        half = len(text) // 2
        edited = text[:len(text) - half] + order[(i + 1) % len(order)][1][:half]
        want.add((doc, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert {(r.doc_id, r.n_chars, r.edited_sha256) for r in rows} == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    texts = {r[0]: r[1] for r in table if r[0] is not None}
    prints = {r.doc_id: r.fingerprint for r in rows if r.doc_id is not None}
    assert prints[3] == prints[206] and texts[3] == texts[206] and prints[200] == prints[201] == ""


def test_texts_without_blanks_keep_likeness_after_an_edit(spark):
    r = random.Random(3)

    def draw(first, last, n=200):
        return "".join(chr(r.randint(first, last)) for _ in range(n))

    rows = [(i, draw(*span)) for i, span in enumerate([(0x4E00, 0x9FFF), (0x3041, 0x3096), (0x0E01, 0x0E2E), (0x61, 0x7A),
                                                        (0x20000, 0x2A000), (0x4E00, 0x9FFF)])]
    found = {x.doc_id: x for x in fingerprint_query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(0.15 < x.near_edited < 0.7 and x.near_next < 0.1 for x in found.values())


def test_units(spark):
    cases = {"two words": ["two", "words"], "a" * 64 + " b": ["a" * 64, "b"], "a" * 65 + " b": [*"a" * 65, "b"], "": [],
             "see 你好 now": ["see", "你", "好", "now"], "x你y": ["x", "你", "y"], "“quoted” – dash": ["“quoted”", "–", "dash"],
             "ÄÖ\u2029z \U00020001q": ["ÄÖ\u2029z", "\U00020001", "q"]}
    rows = spark.createDataFrame([(t,) for t in cases], "text string").select(
        "text", F.regexp_extract_all("text", F.lit(UNITS), F.lit(0)).alias("units")).collect()
    assert {x.text: x.units for x in rows} == cases
