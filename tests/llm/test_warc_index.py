import base64
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from narrascope.llm.warc_index import make_record, parse_record, read_captures, url_key, warc_query, write_archives


def rows():
    out = [(i, f"https://user@Sub{i % 3}.Example.org:80/p/{i}?a={i % 5}#part", f"<p>page {i} é</p>" * (i % 7)) for i in range(300)]
    out += [(900, None, "<p>same</p>"), (901, "no scheme", "<p>same</p>"), (902, "http://a.b/", None), (903, "http://a.b/", ""),
            (904, "http://a.b/\r\nX: y", "<p>same</p>"), (None, "http://c.d/", "<p>same</p>"), (905, "http://long.org/", "w " * 300_000)]
    return [*out, out[4], out[4]]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(rows(), "page_id long, url string, html string").withColumn("record_type", F.lit("clash")).repartition(4)


def want(least):
    body = [(r[0], (r[2] or "").encode()) for r in rows()]
    keeper = {}
    for page, data in body:
        if page is not None:
            keeper[data] = max(page, keeper.get(data, -1))
    out = Counter()
    for page, data in body:
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        revisit = len(data) >= least and keeper.get(data) is not None and keeper[data] != page
        out[(page, len(data), digest, "revisit" if revisit else "response", keeper[data] if revisit else None)] += 1
    return out


def test_round_trip(pages, monkeypatch):
    import narrascope.llm.warc_index as module

    monkeypatch.setattr(module, "LINES", 7)
    assert Counter(tuple(r) for r in warc_query(pages).collect()) == want(0)


def test_small_payloads_are_all_responses(pages):
    folder, directory = write_archives(pages, least_bytes=40)
    assert Counter(tuple(r) for r in read_captures(pages, folder, directory).collect()) == want(40)


def test_single_lookups(spark, pages):
    folder, directory = write_archives(pages)
    keys = spark.createDataFrame([(17, rows()[17][1]), (5000, "http://a.b/")], "page_id long, url string")
    assert [r.page_id for r in read_captures(keys, folder, directory).collect()] == [17]
    # The directory is sparse and its blocks follow each other.
    blocks = spark.read.parquet(directory).orderBy("first_key").collect()
    assert sum(b.captures for b in blocks) == len(rows()) and all(a.last_key <= b.first_key for a, b in zip(blocks, blocks[1:]))


def test_no_pages(pages):
    assert warc_query(pages.limit(0)).count() == 0


def test_records_and_keys(spark):
    data = make_record("http://a.b/", 5, b"ab\r\n\r\nc", 7, "X", None)
    record = parse_record(data)
    assert record["payload"] == b"ab\r\n\r\nc" and record["fields"]["WARC-Type"] == "response"
    urls = {"https://u@Blog.Example.com:8/a?b#c": "com,example,blog)/a?b", "http://x.org": "org,x)", "odd": "odd", None: ""}
    found = spark.createDataFrame([(u,) for u in urls], "url string").select("url", url_key(F.col("url")).alias("k")).collect()
    assert {r.url: r.k for r in found} == urls
