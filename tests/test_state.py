import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from narrascope.streaming import jobs as J

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def test_ids_leave_the_state_and_late_copies_stay_out(spark, tmp_path):
    schema, progress = "id string, ts timestamp, n int", []

    def feed(rows):
        table = spark.createDataFrame([(i, START + dt.timedelta(hours=h), n) for i, h, n in rows], schema)
        table.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = J.stream_table(spark, str(tmp_path / "in"), table.schema)
        query = (J.dedup_with_expiry(stream, "id", "ts", "10 hours", "1 hour").writeStream.format("parquet").outputMode("append")
                 .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
        query.awaitTermination()
        progress.append(sum(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress[-1:]))
        return sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert feed([("a", 0, 1), ("a", 1, 2), ("b", 0, 3), (None, 0, 4), ("b", 3, 5)]) == [1, 3]
    assert progress[-1] == 2
    # Within the lifetime a copy is dropped; 40 hours on all of the first ids have left.
    assert feed([("a", 5, 6), ("c", 40, 7)]) == [1, 3, 7]
    assert progress[-1] == 1
    # A late copy of an id that has left is behind the watermark; a new one is a first row again.
    assert feed([("a", 2, 8), ("b", 41, 9), ("b", 42, 10)]) == [1, 3, 7, 9]
    assert progress[-1] == 2


def test_renewed_ids_stay(spark, tmp_path):
    rows = [("a", h, h) for h in range(0, 40, 5)]
    spark.createDataFrame([(i, START + dt.timedelta(hours=h), n) for i, h, n in rows], "id string, ts timestamp, n int").write.parquet(str(tmp_path / "in"))
    for renew, want in ((True, [0]), (False, [0, 15, 30])):
        stream = J.stream_table(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
        J.run_to_table(J.dedup_with_expiry(stream, "id", "ts", "10 hours", renew=renew), str(tmp_path / f"out{renew}"), str(tmp_path / f"check{renew}"))
        assert sorted(r.n for r in spark.read.parquet(str(tmp_path / f"out{renew}")).select(F.col("n")).collect()) == want


def test_known_id_gives_no_frame():
    class State:
        hasTimedOut, exists, get = False, False, None

        def update(self, value):
            self.exists, self.get = True, value

        def setTimeoutTimestamp(self, at):
            pass

        def getCurrentWatermarkMs(self):
            return 0

    rows = pd.DataFrame({"n": range(4), "ts": pd.to_datetime(["2024-01-03", "2024-01-01", "2024-01-02", "2024-02-01"])})
    day = 86_400_000
    for renew, want in ((False, [1, 0, 3]), (True, [1, 3])):
        step, state = J._expiry_step("ts", day, renew), State()
        out = list(step((), iter([rows.iloc[:2], rows.iloc[2:]]), state))
        assert [n for part in out for n in part["n"]] == want
        assert list(step((), iter([rows.iloc[:2]]), state)) == []


def test_ids_of_a_bucket_pass_as_each_alone(monkeypatch):
    class State:
        hasTimedOut, exists, get, now = False, False, None, 0

        def update(self, value):
            self.exists, self.get = True, value

        def remove(self):
            self.exists, self.get = False, None

        def setTimeoutTimestamp(self, at):
            assert at > self.now

        def getCurrentWatermarkMs(self):
            return self.now

    rng, calls = random.Random(3), 0
    for renew in (False, True):
        state, alone = State(), {}
        step, one = J._bucket_step("ts", 1000, renew), J._expiry_step("ts", 1000, renew)
        for batch in range(6):
            state.now = 3000 * batch
            rows = pd.DataFrame([(f"k{rng.randrange(12)}", 0, 3000 * batch + rng.randrange(4000)) for _ in range(40)], columns=["_id", "_bucket", "ms"])
            rows["n"], rows["ts"] = range(40), pd.to_datetime(rows["ms"], unit="ms")
            got = [n for part in step((), iter([rows.iloc[:15], rows.iloc[15:]]), state) for n in part["n"]]
            calls += 1
            want = []
            for name, own in rows.groupby("_id"):
                want += [n for part in one((), iter([own]), alone.setdefault(name, State())) for n in part["n"]]
            assert sorted(got) == sorted(want)
        state.now, state.hasTimedOut = 10**9, True
        assert list(step((), iter([]), state)) == [] and not state.exists
    # One call for a bucket and batch, not one for each id.
    assert calls == 12
