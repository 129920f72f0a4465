import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import narrascope.llm.fill_middle as module
from narrascope.llm.fill_middle import fill_in_middle, fill_middle_query, restore_text


def plain(doc, text, salt="1:", plain_from=90, spm_below=20):
    """Output, form, n, characters of prefix and middle by plain string work."""
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"{salt}{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= plain_from:
        return text, "plain", n, None, None
    if h4 % 100 < spm_below:
        return f"<S>{s}<P>{p}<M>{m}", "spm", n, len(p), len(m)
    return f"<P>{p}<S>{s}<M>{m}", "psm", n, len(p), len(m)


ODD = [(400, "a<P>b"), (401, "<M>"), (402, "<S"), (403, "<" * 9), (404, "<P ><S"), (405, "é€😀 x"), (406, "😀"), (407, "\n\r\n"), (408, "x"),
       (409, "<S>< P>"), (410, "P><S"), (None, "no id <P"), (None, None)]


@pytest.fixture(scope="module")
def odd(spark, docs):
    rows = docs.select("doc_id", "text", F.lit("own").alias("form"), F.lit(1).alias("fim"))
    more = spark.createDataFrame([(i, t, "own", 1) for i, t in ODD], rows.schema)
    short = spark.createDataFrame([(500 + i, "ab <" * (i % 5), "own", 1) for i in range(200)], rows.schema)
    return rows.union(more).union(short).repartition(3).cache()


def test_outputs_and_restored_texts(odd):
    rows = restore_text(fill_in_middle(odd)).collect()
    assert rows[0].asDict().keys() == {"doc_id", "text", "form", "fim", "restored"} and len(rows) == odd.count()
    for r in rows:
        assert tuple(r.fim[c] for c in ("output", "form", "n", "prefix_chars", "middle_chars")) == plain(r.doc_id, r.text), r.doc_id
        assert r.restored == (r.text or "") and r.form == "own"
    assert {r.fim.form for r in rows} == {"plain", "psm", "spm"}


def test_query_gives_digests(odd):
    found = {tuple(r) for r in fill_middle_query(odd).collect()}
    assert found == {(d, n, form, p, m, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
                     for d, t, *_ in odd.collect() for out, form, n, p, m in [plain(d, t)]}


def test_parameters_and_small_slices(odd, monkeypatch):
    monkeypatch.setattr(module, "SLICE_BYTES", 50)
    rows = restore_text(fill_in_middle(odd, salt="x", plain_from=100, spm_below=50, out="o"), "o.output", "o.form", "text2").collect()
    for r in rows:
        assert r.o.output == plain(r.doc_id, r.text, "x", 100, 50)[0] and r.text2 == (r.text or "")


def test_broken_outputs_are_not_restored(spark):
    rows = [("<P>a<S>b<M>c", "psm"), ("<P>a<M>c", "psm"), ("<P>a<S>b<M>c", "spm"), ("x<P>a<S>b<M>c", "psm"), ("<P>a<S>b<M>c<M>", "psm"),
            ("abc", "other"), ("abc", None), (None, "plain"), ("<S>b<P>a<M>c", "spm")]
    found = restore_text(spark.createDataFrame(rows, "output string, form string").coalesce(1), "output", "form").collect()
    assert [r.restored for r in found] == ["acb", None, None, None, None, None, None, "", "acb"]


def test_no_rows(no_docs):
    assert fill_middle_query(no_docs).count() == 0
    assert restore_text(fill_in_middle(no_docs)).count() == 0


def test_slices_cover_all_texts(monkeypatch):
    monkeypatch.setattr(module, "SLICE_BYTES", 10)
    bounds = np.array([0, 0, 4, 30, 30, 31, 40, 40])
    parts = list(module.slices(bounds))
    assert [i for i, _ in parts] == [0, *(j for _, j in parts[:-1])] and parts[-1][1] == len(bounds) - 1
    assert all(j == i + 1 or bounds[j] - bounds[i] <= 10 for i, j in parts)
