"""Streaming twins: resumable ingest, routed write with ledger, dedup, streaks, live tally.

Progress is kept in the checkpoint folder of each query; a rerun takes up only new files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DateType, IntegralType, StringType, StructType

from narrascope import fixed_values as fixed
from narrascope.operators.aggregates import file_tally
from narrascope.operators.lexicon import Entry
from narrascope.operators.windows import failure_streak, open_streaks
from narrascope.plans.flows import categorise_posts
from narrascope.session import cut_lineage
from narrascope.sinks.commits import commit, new_batch, read_committed, stage
from narrascope.sinks.writers import write_routed
from narrascope.sources.ids import LEDGER_SCHEMA
from narrascope.sources.posts import has_text, scan_tree, stored_records, table_of

REJECTED = "file string, reason string"
#: States that ids with an expiry share; a checkpoint keeps to it.
STATE_BUCKETS = 1 << 10
_NEVER = np.iinfo(np.int64).min


def stream_files(spark: SparkSession, folder: str, files_per_batch: int = 1000, glob: str = "*.csv") -> DataFrame:
    """Paths of the post files of a tree as a stream, outputs and logs excluded by name. No content is read."""
    files = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
             .option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch)
             .load(folder).select("path"))
    name, place = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", "/[^/]*$", "")
    return files.where(~name.contains("_cleaned") & ~place.rlike("logs|filtered_output"))


def stream_table(spark: SparkSession, path: str, schema: StructType, glob: str | None = None) -> DataFrame:
    """Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def _one_path(column: Column) -> Column:
    """A path as text, however many slashes its scheme is written with."""
    return F.regexp_replace(column, "^([a-z0-9]+):/+", "$1:/")


def ingest_files(files: DataFrame, output: str, entries: Iterable[Entry] | None = None, general_terms: Sequence[str] = fixed.GENERAL_TERMS,
                 compat: bool = False, multiline: bool = True) -> str | None:
    """Categorise and route the files (path) that no committed batch holds; gives the name of the new batch, if there is one.

    Each file is read by its own header. A file without a text column is listed among the `rejected`, without a ledger row.
    Posts, ledger and rejected files become visible together by one manifest (see `commits`): an attempt that is killed, or a
    stream whose checkpoint is lost, adds no row twice.
    """
    spark = files.sparkSession
    known = [read_committed(spark, output, table, kinds).select("file") for table, kinds in (("ledger", LEDGER_SCHEMA), ("rejected", REJECTED))]
    asked = files.select(F.col("path"), _one_path(F.col("path")).alias("file")).distinct()
    new = asked.join(known[0].union(known[1]).select(_one_path(F.col("file")).alias("file")), "file", "left_anti")
    # As many paths as the caller takes up at once.
    names = sorted(r.path for r in new.collect())
    if not names:
        return None
    batch = new_batch()
    records, layouts = stored_records(spark, names, multiline=multiline)
    headers = [r.header for r in layouts.select("header").distinct().collect()]
    usable = layouts.where(F.col("header").isin([h for h in headers if has_text(h)]))
    rejected = layouts.join(usable, "file", "left_anti").select("file", F.lit("no text column").alias("reason"))
    stage(rejected, output, "rejected", batch)
    posts = table_of(records, cut_lineage(usable), lineage=True, text_names=fixed.TEXT_COLUMN_NAMES)
    present = {c.lower() for c in posts.columns}
    absent = [F.lit(None).cast("string").alias(c) for c in fixed.POST_COLUMNS if c.lower() not in present]
    done = categorise_posts(posts.select("*", *absent), entries, general_terms, compat).persist()
    try:
        write_routed(done, f"{output}/posts/batch={batch}", mode="overwrite")
        stage(file_tally(done, "source_path"), output, "ledger", batch)
    finally:
        done.unpersist()
    commit(spark, output, batch)
    return batch


def ingest_tree(spark: SparkSession, root: str, output: str, files_per_batch: int = 1000, entries: Iterable[Entry] | None = None,
                general_terms: Sequence[str] = fixed.GENERAL_TERMS, compat: bool = False, multiline: bool = True) -> list[str]:
    """A run over the CSV files of a tree that the ledger does not hold, in batches of about `files_per_batch` files.

    Gives the names of the new batches. A run that was broken off goes on with the files that are left.
    """
    entries = None if entries is None else list(entries)
    files = cut_lineage(scan_tree(spark, root).select(F.col("file").alias("path")))
    parts = max(1, -(-files.count() // files_per_batch))
    found = [ingest_files(files.where(F.pmod(F.xxhash64("path"), F.lit(parts)) == part), output, entries, general_terms, compat, multiline)
             for part in range(parts)]
    return [batch for batch in found if batch]


def start_ingest(files: DataFrame, output: str, checkpoint: str, entries: Iterable[Entry] | None = None,
                 general_terms: Sequence[str] = fixed.GENERAL_TERMS, compat: bool = False, multiline: bool = True) -> StreamingQuery:
    """`ingest_files` for the new files of a stream (see `stream_files`). The committed ledger decides what is new, so that
    replays and lost checkpoints change nothing."""
    entries = None if entries is None else list(entries)

    def write(batch: DataFrame, number: int) -> None:
        ingest_files(batch.select("path"), output, entries, general_terms, compat, multiline)

    return (files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def dedup_stream(df: DataFrame, key: str, time: str | None = None, lateness: str = "1 day") -> DataFrame:
    """First row per id. With a time column, ids are remembered for the lateness only; the column has to
    be a timestamp with zone, so a zone-less one is cast (session zone UTC)."""
    if time is None:
        return df.dropDuplicates([key])
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def _expiry_step(time: str, span: int, renew: bool) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def step(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until, out, parts = (state.get[0] if state.exists else None), [], list(parts)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts)
        # Plain arrays: a call for each key and batch, mostly of a few rows, has no time for frames.
        micros = rows[time].to_numpy("datetime64[us]").astype("int64")
        order = np.argsort(micros, kind="stable")
        at = micros[order] // 1000
        if renew:
            for i, t in enumerate(at):
                if until is None or t > until:
                    out.append(i)
                    until = int(t) + span
                else:
                    until = max(until, int(t) + span)
        else:
            i = 0 if until is None else int(np.searchsorted(at, until, "right"))
            while i < len(at):
                out.append(i)
                until = int(at[i]) + span
                i = int(np.searchsorted(at, until, "right"))
        state.update((until,))
        state.setTimeoutTimestamp(max(until + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield rows.iloc[order[out]]

    return step


def _held(ids: pd.Index, until: np.ndarray) -> bytes:
    return pa.ipc.serialize_pandas(pd.DataFrame({"id": ids, "until": until}), preserve_index=False).to_pybytes()


def _passing(code: np.ndarray, at: np.ndarray, until: np.ndarray, span: int, renew: bool) -> np.ndarray:
    """Which rows are first rows, of rows ordered by id and time; moves `until`, the end of each id's memory, on."""
    found = np.zeros(len(at), bool)
    if not len(at):
        return found
    begins = np.flatnonzero(np.diff(code, prepend=-1))
    ids, ends = code[begins], np.append(begins[1:], len(code))
    if renew:
        # Times rise, so the row before tells until when an id is remembered.
        known = np.concatenate(([_NEVER], at[:-1] + span))
        known[begins] = _NEVER
        found[:] = at > np.maximum(until[code], known)
        until[ids] = np.maximum(until[ids], at[ends - 1] + span)
        return found
    times, rank = np.unique(at, return_inverse=True)
    place = code * (len(times) + 1) + rank
    while len(ids):
        first = np.searchsorted(place, ids * (len(times) + 1) + np.searchsorted(times, until[ids], "right"))
        some = first < ends
        ids, ends, first = ids[some], ends[some], first[some]
        found[first] = True
        until[ids] = at[first] + span
    return found


def _bucket_step(time: str, span: int, renew: bool) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """`_expiry_step` for all ids of a bucket, told by the column `_id`: its state holds the ids that are remembered."""
    def step(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pa.ipc.deserialize_pandas(state.get[0]) if state.exists else pd.DataFrame({"id": pd.Series(dtype=object), "until": np.empty(0, np.int64)})
        ids, until = pd.Index(held["id"]), held["until"].to_numpy()
        if not state.hasTimedOut:
            rows = pd.concat(list(parts), ignore_index=True)
            code, names = pd.factorize(np.concatenate((ids.to_numpy(object), rows["_id"].to_numpy(object))))
            # Ids that are remembered come first and so keep their places.
            code, ids = code[len(until):], pd.Index(names)
            until = np.concatenate((until, np.full(len(ids) - len(until), _NEVER)))
            micros = rows[time].to_numpy("datetime64[us]").astype("int64")
            order = np.lexsort((micros, code))
            out = order[_passing(code[order], micros[order] // 1000, until, span, renew)]
            if len(out):
                yield rows.iloc[out].drop(columns=["_id", "_bucket"])
        now = state.getCurrentWatermarkMs()
        kept = until >= now
        if not kept.any():
            if state.exists:
                state.remove()
            return
        state.update((_held(ids[kept], until[kept]),))
        state.setTimeoutTimestamp(max(int(until[kept].min()) + 1, now + 1))

    return step


def dedup_with_expiry(df: DataFrame, key: str, time: str, lifetime: str = "1 day", lateness: str = "1 hour", renew: bool = False) -> DataFrame:
    """First row per id; an id is remembered for `lifetime` after it was first seen (last seen, with `renew`) and then leaves the state.

    Times are event times. Rows older than the watermark (`lateness` behind the newest row) are dropped, so that a late copy of
    an id that has left does not come through; a copy that is newer than the lifetime is a first row again. Rows without id or time are dropped.
    Plain ids share STATE_BUCKETS states, as a call for each id and batch costs much more than its rows; ids of other kinds have one each.
    """
    kept = df.withColumn(time, F.col(time).cast("timestamp")).where(F.col(key).isNotNull() & F.col(time).isNotNull())
    span = int(pd.Timedelta(lifetime) / pd.Timedelta("1ms"))
    if not isinstance(kept.schema[key].dataType, (StringType, IntegralType, DateType)):
        return kept.withWatermark(time, lateness).groupBy(key).applyInPandasWithState(
            _expiry_step(time, span, renew), kept.schema, "until long", "append", GroupStateTimeout.EventTimeTimeout)
    dealt = kept.withColumn("_id", F.col(key).cast("string")).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(STATE_BUCKETS)).cast("int"))
    return dealt.withWatermark(time, lateness).groupBy("_bucket").applyInPandasWithState(
        _bucket_step(time, span, renew), kept.schema, "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def start_streaks(df: DataFrame, output: str, checkpoint: str, worker: str, order: Sequence[str], failed: Column,
                  piece: Column, limit: int = fixed.STREAK_LIMIT) -> StreamingQuery:
    """Streaks batch by batch, also for workers too busy to be held in one task.

    Every batch counts within parts of the time line and starts from the streaks the batch before
    left open. Both outputs are written below the batch's number, so a replay changes nothing.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        opening = spark.read.parquet(f"{output}/open/batch={number - 1}") if number else None
        done = failure_streak(batch, worker, order, failed, piece, limit, opening=opening)
        done.write.mode("overwrite").parquet(f"{output}/streaks/batch={number}")
        ends = open_streaks(batch, worker, order, failed, piece, opening)
        ends.write.mode("overwrite").parquet(f"{output}/open/batch={number}")

    return (df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def live_tally(posts: DataFrame) -> DataFrame:
    """Running totals per file, for update or complete mode."""
    return file_tally(posts)


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Take up all that is there, write it as Parquet and stop."""
    query = (df.writeStream.format("parquet").outputMode(mode).option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def run_each_batch(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    query = (df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
