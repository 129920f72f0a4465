from pyspark.sql import functions as F

from narrascope import fixed_values as fixed
from narrascope.plans import flows
from narrascope.sinks import commits as C
from narrascope.sinks import writers as O
from narrascope.sources import ids as I
from narrascope.sources import posts as S
from narrascope.streaming import jobs as J

HEADER = "tweetid,Tweet,language,tweetcreatedts\n"


def test_posts_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + '1,"two ""quoted""\nlines",EN,2022-01-01 10:00:00\n2,NA,,bad\n', encoding="utf-8")
    posts = S.read_posts_csv(spark, str(tmp_path / "a.csv"))
    done = {r.tweetid: r for r in flows.categorise_posts(posts).collect()}
    assert done["1"].text == 'two "quoted"\nlines' and done["1"].language == "en" and done["1"].source_file == "a.csv"
    assert done["1"].tweetcreatedts.year == 2022 and done["1"].timezone_assumed == "UTC" and done["1"].is_duplicate is False
    assert done["2"].text == "" and done["2"].language == "other" and done["2"].tweetcreatedts is None
    assert [r.tweetid for r in posts.orderBy("ingest_order").collect()] == ["1", "2"]


def test_tree(spark, tmp_path):
    for name in ("x/a.csv", "x/a_cleaned.csv", "x/b.txt", "logs/c.csv", "filtered_output/d.csv", "y/z/e.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("h\n1\n")
    assert sorted(r.name for r in S.scan_tree(spark, str(tmp_path)).collect()) == ["a.csv", "e.csv"]


def test_id_lists_and_maps(spark, tmp_path):
    (tmp_path / "tweet_ids_2022-3-1.txt").write_text("7\n\nx1\n 9 \n7\n8\nFILE INFORMATION\n55\n", encoding="utf-8")
    (tmp_path / "tweet_ids_2022-10-02.txt").write_text("7\n", encoding="utf-8")
    rows = I.read_id_list(spark, str(tmp_path)).orderBy("source_date", "pos").collect()
    assert [(r.source_date, r.id) for r in rows] == [("2022-10-02", "7"), ("2022-3-1", "7"), ("2022-3-1", "9"), ("2022-3-1", "8")]
    assert [r.source_date for r in I.list_id_files(spark, str(tmp_path)).collect()] == ["2022-10-02", "2022-3-1"]
    (tmp_path / "map.txt").write_text("2,200\n1,200\n2,404\n 2 ,timeout\n")
    assert [tuple(r) for r in I.read_status_map(spark, str(tmp_path / "map.txt")).orderBy("id").collect()] == [("1", 200, None), ("2", None, "timeout")]
    (tmp_path / "failed_worker_0.txt").write_text("5 — write error — again\n10 — empty result\n5 — x\n", encoding="utf-8")
    failed = I.read_failures(spark, str(tmp_path))
    assert failed.first().reason == "write error — again"
    assert [r.id for r in O.recovery_list(failed).collect()] == ["10", "5"]


def test_shards(spark, tmp_path):
    line = "'{0},text,,en,no,no,N/A,N/A,N/A,N/A,N/A,u,,5,\n"
    for i in range(2):
        (tmp_path / f"scraped_worker_{i}.csv").write_text(",".join(fixed.RECORD_COLUMNS) + "\n" + line.format(1) + line.format(2 + i))
    assert sorted(r.id for r in S.read_seen_ids(spark, str(tmp_path)).collect()) == ["1", "2", "3"]
    assert {r.views for r in S.read_shards(spark, str(tmp_path)).collect()} == {None}


def test_ledger_starts_empty(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert I.read_ledger(spark, path).count() == 0
    O.append_ledger(spark.createDataFrame([("f", 3, 2, 0, 1)], I.LEDGER_SCHEMA), path)
    assert tuple(I.read_ledger(spark, path).first()) == ("f", 3, 2, 0, 1)


def test_routed_outputs(spark, tmp_path):
    posts = spark.createDataFrame([("1", "red cross and caritas", "en"), ("1", "red cross again", "en"), ("2", "icrc", "fr"), ("3", "none", "en")],
                                  "tweetid string, text string, language string")
    done = flows.categorise_posts(posts)
    path = str(tmp_path / "out")
    O.ensure_outputs(done, path, ["faith_based", "red_cross"])
    assert spark.read.parquet(path).count() == 0 and len(S.list_files(spark, path, "*.parquet")) >= 6
    O.write_routed(done, path)
    routed = spark.read.parquet(path)
    assert set(fixed.POST_COLUMNS + fixed.LINEAGE_COLUMNS) <= set(routed.columns)
    assert sorted((r.category, r.lang_bucket, r.tweetid) for r in routed.collect()) == [
        ("faith_based", "en", "1"), ("red_cross", "en", "1"), ("red_cross", "en", "1"), ("red_cross", "other", "2")]
    assert flows.deduplicate_outputs(routed, ["text"]).count() == 3


def ingest(spark, root):
    files = J.stream_files(spark, f"{root}/in")
    J.start_ingest(files, f"{root}/out", f"{root}/check").awaitTermination()
    out = f"{root}/out"
    return C.read_committed(spark, out, "posts").count(), sorted(r.total for r in C.read_committed(spark, out, "ledger", I.LEDGER_SCHEMA).collect())


def test_ingest_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in/logs").mkdir(parents=True)
    head = "tweetid,text,language,tweetcreatedts\n"
    (tmp_path / "in/a.csv").write_text(head + "1,red cross,en,2022-01-01\n2,nothing,en,2022-01-01\n")
    (tmp_path / "in/logs/l.csv").write_text(head + "9,red cross,en,2022-01-01\n")
    assert ingest(spark, tmp_path) == (1, [2])
    assert ingest(spark, tmp_path) == (1, [2])
    (tmp_path / "in/b.csv").write_text(head + "3,caritas,ru,bad\n")
    assert ingest(spark, tmp_path) == (2, [1, 2])


def test_files_are_read_by_their_own_header(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("tweetid,Tweet_Text,language,tweetcreatedts\n1,red cross here,en,2022-01-01\n")
    (tmp_path / "in/b.csv").write_text("\ufefflanguage,tweetid,text\nru,2,caritas helps\n", encoding="utf-8")
    (tmp_path / "in/c.csv").write_text("id,body\n3,red cross\n")
    (tmp_path / "in/d.csv").write_text("")
    posts = S.read_posts_csv(spark, str(tmp_path / "in"), S.text_schema(["tweetid", "text", "language"]))
    assert sorted((r.tweetid or "", r.text or "", r.language or "") for r in posts.collect()) == [
        ("", "", ""), ("1", "red cross here", "en"), ("2", "caritas helps", "ru")]
    assert ingest(spark, tmp_path) == (2, [1, 1])
    assert [r.file.split("/")[-1] for r in C.read_committed(spark, f"{tmp_path}/out", "rejected").collect()] == ["c.csv"]
    assert {(r.category, r.lang_bucket) for r in C.read_committed(spark, f"{tmp_path}/out", "posts").collect()} == {
        ("red_cross", "en"), ("faith_based", "ru")}


def test_merged_dates_stay(spark, tmp_path):
    path, columns = str(tmp_path / "merged"), "tweet_id string, text string, source_date string"
    O.write_merged(spark.createDataFrame([("1", "a", "2024-1-1")], columns), path)
    O.write_merged(spark.createDataFrame([("9", "z", "2024-1-1"), ("2", "b", "2024-1-2")], columns), path)
    read = lambda: sorted((str(r.tweet_id), str(r.source_date)) for r in spark.read.option("header", True).csv(path).collect())
    first = read()
    assert [r[0] for r in first] == ["1", "2"]
    O.write_merged(spark.createDataFrame([("9", "z", "2024-1-1")], columns), path, redo=True)
    assert [r[0] for r in read()] == ["2", "9"]


def test_typed_corpus(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text,n,flag\nx,1,true\ny,bad,no\n")
    (tmp_path / "b.csv").write_text("n,text\n7,z\n")
    for multiline in (True, False):
        rows = S.read_corpus(spark, str(tmp_path), "text string, n long, flag boolean", multiline).orderBy("text").collect()
        assert [tuple(r) for r in rows] == [("x", 1, True), ("y", None, False), ("z", 7, None)]


def test_stream_dedup_with_watermark(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 10).cast("string").alias("key"), F.timestamp_seconds("id").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = J.stream_table(spark, str(tmp_path / "in"), rows.schema)
    J.run_to_table(J.dedup_stream(stream, "key", "ts"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
