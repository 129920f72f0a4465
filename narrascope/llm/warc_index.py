"""WARC archives with a two-level capture index.

Pages are sorted by a key of reversed host and path and written as one gzip member for each record. The first index level
is sorted lines of captures in compressed blocks; the second is a sparse directory with the first key and the place of
each block. A lookup searches the directory, reads one block, searches its lines and then reads one record.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.llm.spark import small_batches, write_table
from narrascope.session import scratch_path

#: Lines of an index block, and captures that a task looks up, about.
LINES, LOOKUPS = 256, 8192
DATE = "1970-01-01T00:00:00Z"


def url_key(url: Column) -> Column:
    """Reversed host, a bracket, and what follows the host without fragment: `com,example,blog)/a?b`.

    A URL without scheme and host is its own key; null is the empty key. Hosts are lower-cased, ports and user
    names left out.
    """
    text = F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", "")
    host = F.lower(F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rest = F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.when(host == "", text).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(url: str | None, page_id: int | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit, whose block ends with the HTTP headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict[str, Any]:
    """Headers, HTTP headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    http_fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    return {"fields": fields, "http": http_fields, "payload": payload}


def _page(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "None" else int(value)


def _write(folder: str):
    """Write a task's sorted rows as one archive and one index file; give the directory's rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = _open(folder)
        name = uuid.uuid4().hex
        archive = index = None
        at = index_at = 0
        lines: list[tuple[str, str]] = []

        def block() -> pd.DataFrame:
            nonlocal index_at
            data = gzip.compress("\n".join(line for _, line in lines).encode(), 6, mtime=0)
            index.write(data)
            row = pd.DataFrame({"first_key": [lines[0][0]], "last_key": [lines[-1][0]], "file": [f"{name}.cdx.gz"],
                                "start": [index_at], "size": [len(data)], "captures": [len(lines)]})
            index_at += len(data)
            lines.clear()
            return row

        for batch in batches:
            if archive is None:
                system.create_dir(path, recursive=True)
                archive, index = (system.open_output_stream(f"{path}/{name}.{kind}.gz", compression=None) for kind in ("warc", "cdx"))
            made = []
            for sort_key, page_id, url, html, refers_to, size, digest in batch.itertuples(index=False):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                payload = html.encode() if refers_to is None else None
                digest = payload_digest(payload) if payload is not None else digest
                data = gzip.compress(make_record(url, page_id, payload, size, digest, refers_to), 6, mtime=0)
                archive.write(data)
                lines.append((sort_key, json.dumps([sort_key, f"{name}.warc.gz", at, len(data)])))
                at += len(data)
                if len(lines) == LINES:
                    made.append(block())
            if made:
                yield pd.concat(made)
        if lines:
            yield block()
        if archive is not None:
            archive.close()
            index.close()

    return run


def _read(folder: str, directory: str):
    """Look up a task's sorted keys and read their records."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = _open(folder)
        files: dict[str, Any] = {}
        block: tuple[tuple[str, int], list[list]] = (("", -1), [])
        for batch in batches:
            keys = batch["sort_key"].tolist()
            where, at = _open(directory)
            part = ds.dataset(at, filesystem=where, format="parquet").to_table(
                filter=(ds.field("last_key") >= min(keys)) & (ds.field("first_key") <= max(keys))).to_pandas()
            part = part.sort_values(["first_key", "file", "start"], ignore_index=True)
            lasts, rows = part["last_key"].tolist(), []
            for key in keys:
                # Equal keys can run over several blocks: all from the first block that ends at or after the key.
                for b in range(bisect.bisect_left(lasts, key), len(lasts)):
                    if part["first_key"].iloc[b] > key:
                        break
                    name = (part["file"].iloc[b], int(part["start"].iloc[b]))
                    if block[0] != name:
                        raw = _range(system, files, f"{path}/{name[0]}", name[1], int(part["size"].iloc[b]))
                        block = (name, [json.loads(x) for x in gzip.decompress(raw).decode().split("\n")])
                    own = block[1]
                    for i in range(bisect.bisect_left(own, key, key=lambda x: x[0]), len(own)):
                        if own[i][0] != key:
                            break
                        record = parse_record(gzip.decompress(_range(system, files, f"{path}/{own[i][1]}", own[i][2], own[i][3])))
                        rows.append(_capture(record))
            yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype(
                {"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

    return run


def _range(system: fs.FileSystem, files: dict[str, Any], path: str, start: int, size: int) -> bytes:
    if path not in files:
        # Keys come sorted, so a task reads few files and each to its end before the next.
        while len(files) > 8:
            files.pop(next(iter(files))).close()
        files[path] = system.open_input_file(path)
    return files[path].read_at(size, start)


def _capture(record: dict[str, Any]) -> tuple[Any, ...]:
    fields, payload = record["fields"], record["payload"]
    page_id, kind = _page(fields["WARC-Record-ID"]), fields["WARC-Type"]
    if kind == "revisit":
        return (page_id, int(record["http"]["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), kind,
                _page(fields["WARC-Refers-To"]))
    return page_id, len(payload), payload_digest(payload), kind, None


def _sort_key() -> Column:
    """The URL key, then the page: keys of a frequent URL or host can so be cut into ranges."""
    return F.concat(url_key(F.col("url")), F.lit(" "), F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, "0"))


def write_archives(pages: DataFrame, least_bytes: int = 0) -> tuple[str, str]:
    """Write pages (page_id, url, html) as archives with their index; give the folder and the directory's path.

    Of equal payloads of at least `least_bytes` bytes, the one of the largest page_id is a response and the others revisit
    it. Null html is the empty payload. A null page_id is never the largest; where all are null, all are responses.
    Files of a failed attempt are never named by the directory.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = scratch_path(spark, "archives")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn(
        "same", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html").cast("long"))
    # Written first: mostly few payloads are shared, and then the planner need not move all pages to find these.
    shared, _ = write_table(own.where(F.col("bytes") >= least_bytes).groupBy("same").agg(
        F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("same", "keeper"), "shared")
    marked = own.join(shared, "same", "left").withColumn(
        "refers_to", F.when(~F.col("keeper").eqNullSafe(F.col("page_id")), F.col("keeper")))
    rows = marked.select(
        _sort_key().alias("sort_key"), "page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"),
        "refers_to", "bytes", F.when(F.col("refers_to").isNotNull(), F.sha1("html")).alias("digest")).withColumn(
        "digest", _base32(F.col("digest")))
    directory, _path = write_table(rows.repartitionByRange("sort_key").sortWithinPartitions("sort_key").mapInPandas(
        _write(folder), "first_key string, last_key string, file string, start long, size long, captures int"), "directory")
    return folder, _path


def _base32(digest: Column) -> Column:
    """Base32 of a SHA-1 in hexadecimal: eight groups of 20 bits, four letters each."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

    def group(i: Column) -> Column:
        bits = F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*(F.substring(letters, F.shiftright(bits, 15 - 5 * j).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for j in range(4)))

    return F.when(digest.isNotNull(), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), group), ""))


def read_captures(keys: DataFrame, folder: str, directory: str) -> DataFrame:
    """Captures (page_id, payload_bytes, payload_digest, record_type, refers_to) of keys (url, page_id), found by the index.

    Size and digest of a response are taken from its payload, those of a revisit from its headers. A key that stands in
    keys several times is looked up once.
    """
    found = keys.sparkSession.read.parquet(directory).agg(F.sum("captures")).first()[0] or 0
    tasks = max(1, -(-found // LOOKUPS))
    return keys.select(_sort_key().alias("sort_key")).distinct().repartitionByRange(tasks, "sort_key").sortWithinPartitions(
        "sort_key").mapInPandas(_read(folder, directory),
                                "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_query(pages: DataFrame) -> DataFrame:
    """The contract of op7: write all pages, then look up every page in the archives."""
    folder, directory = write_archives(pages)
    return read_captures(pages, folder, directory)


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
kept AS (SELECT html, max(page_id) AS keeper FROM p GROUP BY html)
SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(8), lambda g: list_reduce(list_transform(range(4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST((CAST('0x' || substr(sha1(p.html), 1 + 5 * CAST(g AS INTEGER), 5) AS BIGINT) >> (15 - 5 * CAST(j AS INTEGER))) & 31 AS INTEGER), 1)),
    lambda a, b: a || b)), '') AS payload_digest,
  CASE WHEN p.page_id = k.keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> k.keeper THEN k.keeper END AS refers_to
FROM p JOIN kept k ON k.html = p.html
"""
