"""CSV files whose quoted fields hold newlines, read in blocks."""

import random

import pytest

from narrascope.sources import posts as S
from narrascope.sources.records import csv_lines, csv_records, header_names


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few kilobytes, so that a file has many."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def field(r):
    kind = r.randrange(9)
    word = "".join(r.choice("ab é語,\"'x") for _ in range(r.randint(0, 12)))
    if kind < 3:
        return '"' + word.replace('"', '""') + '"'
    if kind < 6:
        lines = [word.replace('"', '""') + r.choice(["", ",", '""', " "]) for _ in range(r.randint(1, 5))]
        return '"' + "\n".join(lines) + '"'
    plain = word.replace('"', "").replace(",", "")
    # A quote that does not open its field is an ordinary sign.
    return plain + 'i"n' if kind == 6 and plain.strip() else plain


def write(path, seed, rows, end="\n", long=0):
    r = random.Random(seed)
    out = ["id,a,b,c"]
    for i in range(rows):
        text = '"' + "word\n" * long + '"' if long and i % 40 == 7 else field(r)
        out.append(f"{i},{text},{field(r)},{field(r)}")
    path.write_text("\n".join(out).replace("\n", end) + end, encoding="utf-8", newline="")


def whole_files(spark, path):
    """The rows as Spark's own reader gives them, a task for each file."""
    return (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("recursiveFileLookup", True)
            .schema("id string, a string, b string, c string").csv(path))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_blocks_give_the_rows_of_whole_files(spark, tmp_path, small_blocks, end):
    (tmp_path / "in/sub").mkdir(parents=True)
    write(tmp_path / "in/a.csv", 1, 700, end)
    write(tmp_path / "in/sub/b.csv", 2, 300, end, long=1500)
    (tmp_path / "in/c.csv").write_text("id,a,b,c\n9,x,,\n\n10,\"\",y,z", newline="")
    lines = csv_lines(spark, str(tmp_path / "in"))
    assert lines.select("file", "block").distinct().count() > 20
    found = S.read_by_header(spark, str(tmp_path / "in"), lineage=True)
    plain = S.null_tokens(whole_files(spark, str(tmp_path / "in")))
    assert sorted(map(str, found.select("id", "a", "b", "c").collect())) == sorted(map(str, plain.collect()))
    order = [r.id for r in found.where("source_file = 'a.csv'").orderBy("ingest_order").collect()]
    assert order == [str(i) for i in range(700)]


def test_blocks_within_one_record(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text('x,y\n1,"' + "line, \"\"with\"\" words\n" * 2000 + '"\n2,"b\nc"\n', encoding="utf-8")
    rows = S.read_by_header(spark, str(tmp_path / "a.csv")).orderBy("x").collect()
    assert [r.x for r in rows] == ["1", "2"] and rows[0].y == 'line, "with" words\n' * 2000 and rows[1].y == "b\nc"


def test_an_open_quote_ends_with_the_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,a\n2,"never closed\n3,b\n')
    (tmp_path / "b.csv").write_text("x,y\n4,c\n")
    records = csv_records(csv_lines(spark, str(tmp_path)))
    assert sorted(r.text for r in records.collect()) == ['1,a', '2,"never closed\n3,b', "4,c", "x,y", "x,y"]


def test_headers_with_newlines_and_names_that_differ_in_case(spark, tmp_path):
    (tmp_path / "a.csv").write_text('tweetid,"two\nlines",text\n1,x,hello\n')
    (tmp_path / "b.csv").write_text("Text,text,TWEETID,,\nfirst,second,2,u,v\n")
    posts = S.read_posts_csv(spark, str(tmp_path))
    rows = {r.tweetid: r for r in posts.select("tweetid", "text", posts["`two\nlines`"].alias("two"), "_3", "_4").collect()}
    assert rows["1"].text == "hello" and rows["1"].two == "x"
    assert rows["2"].text == "first" and rows["2"]["_3"] == "u" and rows["2"]["_4"] == "v"
    assert header_names("﻿a,A,,b") == ("a", "A_1", "_2", "b")


def test_more_layouts_than_one_expression_holds(spark, tmp_path, monkeypatch):
    import narrascope.sources.records as module

    monkeypatch.setattr(module, "LAYOUTS", 2)
    for i in range(5):
        (tmp_path / f"{i}.csv").write_text(f"id,c{i}\n{i},v{i}\n")
    rows = S.read_by_header(spark, str(tmp_path)).collect()
    assert sorted((r.id, r[f"c{r.id}"]) for r in rows) == [(str(i), f"v{i}") for i in range(5)]
    assert all(r[f"c{j}"] is None for r in rows for j in range(5) if str(j) != r.id)


def test_no_files(spark, tmp_path):
    assert S.read_by_header(spark, str(tmp_path), ["a"], lineage=True).count() == 0
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "blank.csv").write_text("\n\r\n")
    (tmp_path / "head.csv").write_text("a,b")
    for multiline in (True, False):
        assert S.read_by_header(spark, str(tmp_path), multiline=multiline).count() == 0


def test_records_over_several_arrow_batches(spark, tmp_path, small_blocks):
    write(tmp_path / "a.csv", 3, 200, long=30)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = S.null_tokens(S.read_by_header(spark, str(tmp_path)))
        assert sorted(map(str, found.collect())) == sorted(map(str, S.null_tokens(whole_files(spark, str(tmp_path))).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_texts_are_not_shuffled_and_parsed_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,a,b,c\n1,"x\ny",p,q\n')
    (tmp_path / "b.csv").write_text("c,id\nz,2\n")
    records, layouts = S.stored_records(spark, str(tmp_path))
    assert "Exchange" not in records._jdf.queryExecution().executedPlan().toString()
    table = S.table_of(records, layouts)
    assert table._jdf.queryExecution().optimizedPlan().toString().count("from_csv") == 1
    assert sorted(map(str, table.select("id", "a", "b", "c").collect())) == sorted(map(str, spark.createDataFrame(
        [("1", "x\ny", "p", "q"), ("2", None, None, "z")], "id string, a string, b string, c string").collect()))
