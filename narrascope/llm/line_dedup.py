"""Drop lines that an earlier document holds, by range-partitioned line hashes (compare Lee et al. 2022, Raffel et al. 2020).

Lines become (hash, document, position) rows. They are dealt out by ranges of that order, so even the rows of one very
common line spread over many tasks, and are sorted within each range. A task then streams its rows: the first
document of a hash keeps it, rows of later documents are drops. Only of the first hash of a range the first document
may lie before the range; such rows wait for the least document over the ends of all ranges, at most two rows for each
range. What comes back is a compressed bitmap of the lines to keep for each document, not text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.llm.spark import small_batches, write_table

SPACE = b" \t\n\v\f\r"
_ROW = ("hi", "lo", "doc_id", "row", "pos")
_LINES = "hi long, lo long, doc_id long, row long, pos int"
#: What a streamed row says: a drop, a row of the first hash of its range, the first document at an end of a range.
DROP, OPEN, END = 0, 1, 2


def line_key(line: bytes) -> bytes:
    """The line without blanks at both ends, A-Z lower-cased."""
    return line.strip(SPACE).lower()


def long_enough(key: bytes, least_chars: int) -> bool:
    return len(key) >= least_chars and (len(key) >= 4 * least_chars or len(key.decode("utf-8", "replace")) >= least_chars)


def _line_rows(docs: DataFrame, least_chars: int) -> DataFrame:
    """A row for each line that is long enough: 128-bit hash of its key, document, row of the document, position."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, places, owners = bytearray(), [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for pos, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
                    key = line_key(line)
                    if long_enough(key, least_chars):
                        hashes += hashlib.blake2b(key, digest_size=16).digest()
                        places.append(pos)
                        owners.append(i)
            pairs = np.frombuffer(bytes(hashes), np.int64).reshape(-1, 2)
            owner = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), batch.column("doc_id").take(owner), batch.column("row").take(owner),
                 pa.array(places, pa.int32())], names=list(_ROW))

    return docs.mapInArrow(run, _LINES)


class FirstDocuments:
    """Streams the sorted rows of a range; `feed` gives the rows to emit, `close` the last ones."""

    def __init__(self) -> None:
        self.key: tuple[int, int] | None = None
        self.doc = 0
        self.leading = True

    def feed(self, hi: np.ndarray, lo: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the rows to emit and what each says (DROP or OPEN)."""
        if not len(hi):
            return np.empty(0, np.int64), np.empty(0, np.int32)
        fresh = np.ones(len(hi), bool)
        fresh[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        first_here, was_open = doc[np.flatnonzero(fresh)], self.key is None
        if self.key is None:
            self.head = (int(hi[0]), int(lo[0]), int(doc[0]))
        elif self.key == (hi[0], lo[0]):
            first_here = first_here.copy()
            first_here[0], was_open = self.doc, self.leading
        run = np.cumsum(fresh) - 1
        kind = np.where((run == 0) & was_open, OPEN, np.where(doc != first_here[run], DROP, -1))
        self.leading = bool(was_open and run[-1] == 0)
        self.key, self.doc = (int(hi[-1]), int(lo[-1])), int(first_here[-1])
        rows = np.flatnonzero(kind >= 0)
        return rows, kind[rows].astype(np.int32)

    def close(self) -> list[tuple[int, int, int]]:
        """(hi, lo, first document) of the first and the last hash."""
        return [] if self.key is None else [self.head, (*self.key, self.doc)]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, state = [*_ROW, "kind"], FirstDocuments()
    for batch in batches:
        rows, kind = state.feed(*(batch.column(c).to_numpy() for c in ("hi", "lo", "doc_id")))
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in _ROW), pa.array(kind)], names=names)
    ends = state.close()
    yield pa.RecordBatch.from_arrays(
        [*(pa.array([e[i] for e in ends], pa.int64()) for i in range(3)), pa.nulls(len(ends), pa.int64()),
         pa.nulls(len(ends), pa.int32()), pa.array([END] * len(ends), pa.int32())], names=names)


def _row_of(text: str) -> F.Column:
    """Tells the rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def line_bitmaps(docs: DataFrame, text: str = "text", key: str = "doc_id", least_chars: int = 10) -> DataFrame:
    """(doc_id, row, keep binary) for each document that loses lines; `row` is a hash of the text.

    A line's key is the line without blanks at both ends, A-Z lower-cased. A key of at least `least_chars` code points
    stays in the smallest doc_id that holds it, as often as it stands there, and goes from all others. Rows of one
    doc_id are one document; rows without doc_id neither lose lines nor count. `keep` is a zlib-packed bitmap with
    a set bit for each line that stays; lines beyond its end stay.
    """
    small_batches(docs.sparkSession)
    # Repeated rows are taken together before the shuffle, so that a row in millions of copies fills no range.
    owned = docs.where(F.col(key).isNotNull() & (F.length(text) >= least_chars)).select(
        F.col(key).cast("long").alias("doc_id"), _row_of(text).alias("row"), F.col(text).alias("text"))
    lines, _ = write_table(_line_rows(owned, least_chars).distinct(), "lines")
    streamed, _ = write_table(lines.repartitionByRange(*_ROW).sortWithinPartitions(*_ROW).mapInArrow(_stream, f"{_LINES}, kind int"), "drops")
    # Two rows for each range at most.
    ends = F.broadcast(streamed.where(F.col("kind") == END).groupBy("hi", "lo").agg(F.min("doc_id").alias("first_doc")))
    late = streamed.where(F.col("kind") == OPEN).join(ends, ["hi", "lo"]).where("doc_id > first_doc")
    drops = streamed.where(F.col("kind") == DROP).select("doc_id", "row", "pos").union(late.select("doc_id", "row", "pos"))

    def pack(places: pa.Array) -> pa.Array:
        out = []
        for own in places:
            own = own.values.to_numpy()
            bits = np.ones(int(own.max()) + 1, bool)
            bits[own] = False
            out.append(struct.pack("<q", len(bits)) + zlib.compress(np.packbits(bits).tobytes()))
        return pa.array(out, pa.binary())

    pack.__annotations__ = {"places": pa.Array, "return": pa.Array}
    return drops.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("places")).select(
        "doc_id", "row", F.arrow_udf(pack, "binary")("places").alias("keep"))


def kept_lines(count: int, keep: bytes | None) -> np.ndarray:
    """Whether each of the lines stays."""
    stays = np.ones(count, bool)
    if keep is not None:
        size = min(struct.unpack("<q", keep[:8])[0], count)
        stays[:size] = np.unpackbits(np.frombuffer(zlib.decompress(keep[8:]), np.uint8), count=size).astype(bool)
    return stays


def keep_lines(docs: DataFrame, bitmaps: DataFrame, text: str = "text", key: str = "doc_id", out: str = "lines") -> DataFrame:
    """Add the struct (n_lines, n_dropped, kept) to each document, in place of a column of that name.

    A null or empty text is one empty line. Documents without bitmap keep all. Other columns come through unchanged.
    """
    small_batches(docs.sparkSession)
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != out]).alias("doc"), F.col(text).alias("text"),
                       F.col(key).cast("long").alias("doc_id"), _row_of(text).alias("row"))

    def run(texts: pa.Array, keeps: pa.Array) -> pa.Array:
        counts, dropped, kept = [], [], []
        for value, keep in zip(texts, keeps.to_pylist()):
            value = value.as_py() or ""
            if keep is None:
                counts.append(value.count("\n") + 1)
                dropped.append(0)
                kept.append(value)
                continue
            lines = value.split("\n")
            stays = kept_lines(len(lines), keep)
            counts.append(len(lines))
            dropped.append(int(len(lines) - stays.sum()))
            kept.append("\n".join([line for line, stay in zip(lines, stays) if stay]))
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())],
                                          ["n_lines", "n_dropped", "kept"])

    run.__annotations__ = {"texts": pa.Array, "keeps": pa.Array, "return": pa.Array}
    apply = F.arrow_udf(run, "n_lines long, n_dropped long, kept string").asNondeterministic()
    return left.join(bitmaps, ["doc_id", "row"], "left").select("doc", apply("text", "keep").alias("result")).select(
        "doc.*", F.col("result").alias(out))


def line_dedup_query(docs: DataFrame) -> DataFrame:
    """The contract of op12."""
    rows = docs.select("doc_id", "text")
    done = keep_lines(rows, line_bitmaps(rows))
    return done.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("lines.kept", 256).alias("kept_sha256"))


LINES_SQL = """
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM rows_),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.*, coalesce(k.doc_id > f.first_doc, false) AS gone FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
