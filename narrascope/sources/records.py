"""Records of CSV files whose quoted fields may hold newlines, read by many tasks for each file.

A file is read line by line in blocks, as any text. Whether a line starts inside quotes depends on all lines before
it, but each line only maps the state before it (outside or inside quotes) to the one after it. Such maps are chained in two
levels: within the blocks, which knows neither the state before them, and over the blocks of a file, one row each. The lines of
a record are then joined in Arrow batches where they are read, and only records across blocks are shuffled. Each record is parsed by the
layout of its file's own header.
"""

from __future__ import annotations

import csv
import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from narrascope.session import cut_lineage

BLOCK = ("file", "block")
#: Layouts that one expression tells apart; further ones are read by further passes over the records.
LAYOUTS = 16


def plain_path(column: Column) -> Column:
    """The path of a file from the scan's metadata, which writes it as in a URL, as listings write it."""
    return F.url_decode(F.replace(column, F.lit("+"), F.lit("%2B")))


def csv_lines(spark: SparkSession, paths: str | Sequence[str], glob: str = "*", tolerant: bool = False) -> DataFrame:
    """(file, name, block, row, line) of the lines of files, `row` rising within a block. Large files are split over tasks."""
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "\n")
             .option("ignoreCorruptFiles", tolerant).option("ignoreMissingFiles", tolerant)
             .text(paths if isinstance(paths, str) else list(paths)))
    return lines.select(plain_path(F.col("_metadata.file_path")).alias("file"), plain_path(F.col("_metadata.file_name")).alias("name"),
                        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"),
                        F.col("value").alias("line"))


def _odd_runs(lines: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """(line, opens) of the runs of quotes of odd length, in order: the place of the line, and whether the run may open a field.

    A quote opens a field at the start of the line or behind a comma, and is an ordinary sign elsewhere outside quotes.
    Inside, a doubled quote is one sign of the field and any other quote closes it. So a run of even length keeps the state before it, an
    odd one that may open a field turns it, and any other odd one leaves the state outside whatever it was.
    """
    _, ends, data = lines.buffers()
    ends = np.frombuffer(ends, np.int64)[lines.offset:lines.offset + len(lines) + 1]
    signs = np.frombuffer(data or b"", np.uint8)
    at = np.flatnonzero(signs[ends[0]:ends[-1]] == ord('"')) + ends[0]
    line = np.searchsorted(ends, at, "right") - 1
    first = np.ones(len(at), bool)
    first[1:] = (np.diff(at) != 1) | (np.diff(line) != 0)
    runs = np.flatnonzero(first)
    runs = runs[np.diff(np.append(runs, len(at))) % 2 == 1]
    at, line = at[runs], line[runs]
    return line, (at == ends[line]) | (signs[at - 1] == ord(","))


def _states(opens: np.ndarray, state: int) -> np.ndarray:
    """The state (0 outside, 1 inside) behind each of some odd runs, if they start in `state`. Behind the last fixing run only turns count."""
    turns = np.cumsum(opens)
    fixing = np.maximum.accumulate(np.where(opens, -1, np.arange(len(opens))))
    return (turns - np.where(fixing < 0, -state, turns[fixing])) % 2


def _of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch, pa.LargeStringArray]]:
    """((file, block), rows, lines) of consecutive rows of one block."""
    for batch in batches:
        block, file = batch.column("block").to_numpy(), batch.column("file").dictionary_encode().indices.to_numpy()
        edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(file) != 0)) + 1
        for a, b in zip((0, *edges), (*edges, len(block))) if len(block) else ():
            rows = batch.slice(a, b - a)
            yield (rows.column("file")[0].as_py(), int(block[a])), rows, rows.column("line").cast(pa.large_string())


def _block_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, outside, inside): the state behind each block, if it starts outside quotes and if it starts inside."""
    ends: dict[tuple, list[int]] = {}
    for key, _, lines in _of_blocks(batches):
        states = ends.setdefault(key, [0, 1])
        _, opens = _odd_runs(lines)
        if len(opens):
            ends[key] = [int(_states(opens, state)[-1]) for state in states]
    yield pa.RecordBatch.from_pylist([{"file": f, "block": b, "outside": o, "inside": i} for (f, b), (o, i) in ends.items()], schema=pa.schema(
        [("file", pa.string()), ("block", pa.int64()), ("outside", pa.int32()), ("inside", pa.int32())]))


def _block_starts(maps: DataFrame) -> DataFrame:
    """(file, block, inside): the state before each block, from one row for each block."""
    ends = maps.select(*BLOCK, F.when(F.col("outside") == F.col("inside"), F.col("outside")).alias("fixed"),
                       (F.col("outside") > F.col("inside")).cast("int").alias("swapped"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("turns", F.coalesce(F.sum("swapped").over(before), F.lit(0)))
    own = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "turns")), ignorenulls=True).over(before)
    return ends.withColumn("own", own).select(
        *BLOCK, ((F.coalesce("own.fixed", F.lit(0)) + F.col("turns") - F.coalesce("own.turns", F.lit(0))) % 2).alias("inside"))


def _block_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, name, block, record, last, text): the records that start in each block, numbered from 1, and as record 0 the lines before the
    first of them. The last row of a block is marked; its record may go on in the next one."""
    def rows(key: tuple, name: str, first: int, texts: pa.Array, last: bool = False) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_arrays(
            [pa.repeat(key[0], n), pa.repeat(name, n), pa.repeat(pa.scalar(key[1], pa.int64()), n), pa.array(np.arange(first, first + n)),
             pa.repeat(last, n), texts.cast(pa.string())], names=["file", "name", "block", "record", "last", "text"])

    of, name, record, state, held = None, "", 0, 0, []
    for key, part, lines in _of_blocks(batches):
        if key != of:
            if held:
                yield rows(of, name, record, pa.array(["\n".join(held)]), True)
            of, name, record, state, held = key, part.column("name")[0].as_py(), 0, part.column("inside")[0].as_py(), []
        line, opens = _odd_runs(lines)
        after = np.append(_states(opens, state), state)
        # The place in front of the first run is the last one of `after`.
        starts = np.flatnonzero(after[np.searchsorted(line, np.arange(len(lines))) - 1] == 0)
        state = int(after[len(opens) - 1])
        held += lines.slice(0, starts[0] if len(starts) else len(lines)).to_pylist()
        if len(starts):
            if held:
                yield rows(key, name, record, pa.array(["\n".join(held)]))
            whole = pa.ListArray.from_arrays(pa.array(starts - starts[0], pa.int32()), lines.slice(starts[0], starts[-1] - starts[0]))
            yield rows(key, name, record + 1, pc.binary_join(whole, pa.scalar("\n", pa.large_string())))
            record, held = record + len(starts), lines.slice(starts[-1]).to_pylist()
    if held:
        yield rows(of, name, record, pa.array(["\n".join(held)]), True)


def csv_records(lines: DataFrame, multiline: bool = True) -> DataFrame:
    """(file, name, block, record, text) of the records of files: `record` numbers them within the block they start in.

    Blank records are left out. With `multiline` off every line is a record; otherwise the lines have to come as `csv_lines` reads
    them, each block in order in one task, and the records are written once. Only the records at the ends of blocks are shuffled.
    """
    written = F.col("text").rlike("[^\r ]")
    if not multiline:
        return lines.where(F.trim(F.regexp_replace("line", "\r", "")) != "").select("file", "name", "block", F.col("row").alias("record"), F.col("line").alias("text"))
    # Read once for the blocks' maps and once for the lines.
    maps = lines.select(*BLOCK, "line").mapInArrow(_block_maps, "file string, block long, outside int, inside int")
    inside = cut_lineage(_block_starts(maps)).where("inside = 1")
    # At most one row for each block of the input. A shuffle would lose the order of the lines.
    started = lines.join(F.broadcast(inside), list(BLOCK), "left").select("file", "name", "block", F.coalesce("inside", F.lit(0)).alias("inside"), "line")
    found = cut_lineage(started.mapInArrow(_block_records, "file string, name string, block long, record long, last boolean, text string"))
    edges = found.where("record = 0 or last")
    # Lines before the first record of a block belong to the last record before it, some blocks ago.
    counts = edges.groupBy(*BLOCK).agg(F.max("record").alias("records"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    holders = counts.withColumn("held", F.last(F.when(F.col("records") > 0, F.struct("block", "records")), ignorenulls=True).over(before)).select(
        *BLOCK, F.col("held.block").alias("home"), F.col("held.records").alias("record"))
    spilled = edges.where("record = 0").drop("record").join(holders, list(BLOCK))
    placed = edges.where("record > 0").withColumn("home", F.col("block")).unionByName(spilled)
    joined = placed.groupBy("file", "name", "home", "record").agg(F.sort_array(F.collect_list(F.struct("block", "text"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["text"]), "\n")
    ends = cut_lineage(joined.select("file", "name", F.col("home").alias("block"), "record", text.alias("text")))
    return found.where("record > 0 and not last").select(*ends.columns).unionByName(ends).where(written)


def header_names(header: str) -> tuple[str, ...]:
    """Column names of a header record. Names are told apart without regard to case: a repeated or blank one gets its position as suffix."""
    names, used = [], set()
    for i, name in enumerate(next(csv.reader([header.removeprefix("﻿")], strict=False), [])):
        if not name.strip() or name.lower() in used:
            name = f"{name}_{i}"
        used.add(name.lower())
        names.append(name)
    return tuple(names)


def _one_line(header: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(header, "\r\n", "\n"), "\r$", "")


def file_layouts(records: DataFrame) -> DataFrame:
    """(file, block, record, header, crlf): the first record of each file, and whether its lines end in two signs."""
    first = records.groupBy("file").agg(F.min(F.struct("block", "record", "text")).alias("h"))
    return first.select("file", F.col("h.block").alias("block"), F.col("h.record").alias("record"),
                        _one_line(F.col("h.text")).alias("header"), F.col("h.text").endswith("\r").alias("crlf"))


def parse_records(records: DataFrame, layouts: DataFrame, headers: Sequence[str],
                  rename: Callable[[tuple[str, ...]], tuple[str, ...]] = lambda names: names) -> DataFrame:
    """Records as text columns named by the header of their file, columns of other layouts being null, next to _file, _name, _block
    and _record.

    `headers` are the distinct headers. Columns of two files whose names differ in case only are one column, named as first met.
    """
    names = {h: rename(header_names(h)) for h in headers}
    united: dict[str, str] = {}
    for h in headers:
        for name in names[h]:
            united.setdefault(name.lower(), name)
    kept = ("file", "name", "block", "record")
    heads = layouts.select(F.col("file").alias("of"), F.col("block").alias("head_block"), F.col("record").alias("head_record"), "header", "crlf")
    rows = records.join(heads, F.col("file") == F.col("of")).where("not (block = head_block and record = head_record)")
    text = F.when(F.col("crlf"), _one_line(F.col("text"))).otherwise(F.regexp_replace("text", "\r$", ""))
    rows = rows.select(*kept, "header", text.alias("text"))

    def parsed(group: Sequence[str]) -> DataFrame:
        # One schema for all layouts, as wide as the widest, so that a generator evaluates the parser once for all columns. The options
        # are those of the reader of whole files.
        schema = ", ".join(f"c{i} string" for i in range(max(len(names[h]) for h in group)))
        cells = F.from_csv(F.col("text"), schema, {"quote": '"', "escape": '"'})
        layout = functools.reduce(lambda rest, h: F.when(F.col("header") == h, group.index(h)).otherwise(rest), group, F.lit(None).cast("int"))
        part = rows if len(headers) <= LAYOUTS else rows.where(F.col("header").isin(list(group)))
        part = part.select(*kept, F.explode(F.array(F.struct(cells.alias("c"), layout.alias("layout")))).alias("v"))
        own = [{n.lower(): f"c{i}" for i, n in enumerate(names[h])} for h in group]

        def column(low: str) -> Column:
            places = [o.get(low) for o in own]
            value = F.lit(None).cast("string")
            for place in sorted({p for p in places if p}):
                holders = [i for i, p in enumerate(places) if p == place]
                value = F.when(F.col("v.layout").isin(holders), F.col(f"v.c.{place}")).otherwise(value)
            return value

        return part.select(*[F.col(c).alias(f"_{c}") for c in kept], *[column(low).alias(name) for low, name in united.items()])

    groups = [headers[i:i + LAYOUTS] for i in range(0, len(headers), LAYOUTS)]
    return functools.reduce(DataFrame.unionByName, map(parsed, groups))
