import pytest
from pyspark.sql import functions as F

from narrascope.operators import joins as J
from narrascope.sinks import commits as C
from narrascope.sinks import writers as O
from narrascope.sources.ids import LEDGER_SCHEMA
from narrascope.streaming import jobs

HEAD = "tweetid,text,language,tweetcreatedts\n"


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "in/a b").mkdir(parents=True)
    (tmp_path / "in/a.csv").write_text(HEAD + '1,"red cross\nagain",en,2022-01-01\n2,nothing,en,2022-01-01\n')
    (tmp_path / "in/a b/b c.csv").write_text(HEAD + "3,caritas,ru,bad\n")
    (tmp_path / "in/c.csv").write_text("id,body\n3,red cross\n")
    return tmp_path


def state(spark, out):
    posts, ledger, rejected = (C.read_committed(spark, out, t, s) for t, s in (("posts", None), ("ledger", LEDGER_SCHEMA), ("rejected", jobs.REJECTED)))
    return posts.count(), sorted(r.total for r in ledger.collect()), rejected.count()


def stream(spark, root, checkpoint):
    jobs.start_ingest(jobs.stream_files(spark, f"{root}/in"), f"{root}/out", f"{root}/{checkpoint}").awaitTermination()


def test_batch_run_takes_what_the_ledger_does_not_hold(spark, tree):
    out = str(tree / "out")
    assert C.read_committed(spark, out, "ledger", LEDGER_SCHEMA).count() == 0
    assert len(jobs.ingest_tree(spark, str(tree / "in"), out, files_per_batch=1)) in (1, 2, 3)
    assert state(spark, out) == (2, [1, 2], 1)
    assert jobs.ingest_tree(spark, str(tree / "in"), out) == [] and state(spark, out) == (2, [1, 2], 1)
    stream(spark, tree, "check")
    assert state(spark, out) == (2, [1, 2], 1)
    (tree / "in/d.csv").write_text(HEAD + "4,caritas,en,bad\n")
    stream(spark, tree, "check")
    assert state(spark, out) == (3, [1, 1, 2], 1)


def test_lost_checkpoint_adds_nothing(spark, tree):
    for checkpoint in ("one", "other"):
        stream(spark, tree, checkpoint)
        assert state(spark, f"{tree}/out") == (2, [1, 2], 1)


@pytest.mark.parametrize("where", ["write_routed", "stage", "commit"])
def test_attempt_killed_between_its_writes_is_not_seen(spark, tree, monkeypatch, where):
    out, calls = str(tree / "out"), []
    inner = getattr(jobs, where)

    def killed(*args, **options):
        calls.append(1)
        if where == "stage" and len(calls) == 1:
            return inner(*args, **options)
        if where == "write_routed":
            inner(*args, **options)
        raise RuntimeError("killed")

    monkeypatch.setattr(jobs, where, killed)
    with pytest.raises(RuntimeError):
        jobs.ingest_tree(spark, str(tree / "in"), out)
    monkeypatch.undo()
    assert C.manifests(spark, out).count() == 0
    jobs.ingest_tree(spark, str(tree / "in"), out)
    assert state(spark, out) == (2, [1, 2], 1)
    left = {"write_routed": 2, "stage": 2, "commit": 3}[where]
    assert C.drop_uncommitted(spark, out, "posts", "ledger", "rejected") == left and state(spark, out) == (2, [1, 2], 1)


def test_two_runs_cannot_take_one_number(spark, tmp_path, monkeypatch):
    out = str(tmp_path)
    C.stage(spark.range(3), out, "t", "a")
    C.stage(spark.range(5), out, "t", "b")
    assert C.commit(spark, out, "a") == 0 and C.read_committed(spark, out, "t").count() == 3
    none = C.manifests(spark, out).limit(0)
    monkeypatch.setattr(C, "manifests", lambda *_: none)
    with pytest.raises(Exception, match="exist"):
        C.commit(spark, out, "b")
    monkeypatch.undo()
    assert C.read_committed(spark, out, "t").count() == 3
    assert C.commit(spark, out, "b") == 1 and C.read_committed(spark, out, "t", "id long").count() == 8


def test_seen_ids_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "seen ids")
    name = J.seen_table(spark, path, 8)
    J.add_seen(spark.createDataFrame([(str(i % 60),) for i in range(100)] + [(None,)], "id string"), name, buckets=8)
    J.add_seen(spark.createDataFrame([(str(i),) for i in range(50, 70)], "id string"), name, buckets=8)
    assert spark.table(name).count() == 70
    spark.sql(f"DROP TABLE {name}")
    # Another session finds the table by its path.
    assert J.seen_table(spark, path, 8) == name and spark.table(name).count() == 70
    new = J.anti_seen_table(spark.createDataFrame([("5",), ("69",), ("70",), ("70",), (None,)], "id string"), name, buckets=8)
    assert sorted(str(r.id) for r in new.collect()) == ["70", "70", "None"]
    plan = new._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    spark.sql(f"DROP TABLE {name}")


def test_only_partitions_with_repeats_are_written_again(spark, tmp_path):
    path = str(tmp_path / "routed")
    rows = [("1", 0, "a", "en"), ("2", 1, "a", "en"), ("1", 2, "a", "en"), (None, 3, "a", "en"), (None, 4, "a", "en"),
            ("1", 5, "a", "ru"), ("1", 6, "b c", "en"), ("2", 7, "b c", "en")]
    write = lambda rows, batch: spark.createDataFrame(rows, "tweetid string, n int, category string, lang_bucket string").withColumn(
        "batch", F.lit(batch)).coalesce(1).write.mode("append").partitionBy("batch", "category", "lang_bucket").parquet(path)
    write(rows, "x")
    write([("1", 8, "b c", "en"), ("2", 9, "b c", "en"), ("3", 10, "a", "ru")], "y")
    names = lambda: {f.split("/routed/")[1] for f in spark.read.parquet(path).inputFiles()}
    before = names()
    assert O.deduplicate_in_place(spark, path, "tweetid", ["n"]) == 2
    kept = sorted(r.n for r in spark.read.parquet(path).collect())
    assert kept == [0, 1, 3, 4, 5, 6, 7, 10]
    gone = {f for f in before - names()}
    assert len(gone) == 2 and all(f.startswith(("batch=x/category=a/lang_bucket=en", "batch=y/category=b")) for f in gone)
    again = names()
    assert O.deduplicate_in_place(spark, path, "tweetid", ["n"]) == 0 and names() == again
