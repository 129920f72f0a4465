"""Post tables: CSV trees, corpora, shards, stored pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from narrascope import fixed_values as fixed
from narrascope.functions import text as X
from narrascope.operators.predicates import null_tokens
from narrascope.session import cut_lineage
from narrascope.sources.records import csv_lines, csv_records, file_layouts, header_names, parse_records


def text_schema(columns: Sequence[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in dict.fromkeys(columns)])


def list_files(spark: SparkSession, paths: str | Sequence[str], glob: str = "*") -> list[str]:
    """Files of folders or single files, by path. Only the listing is read."""
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
              .load(list(paths) if not isinstance(paths, str) else paths).select("path"))
    return sorted(r.path for r in listed.collect())


def has_text(header: str, text_names: Sequence[str] = fixed.TEXT_COLUMN_NAMES) -> bool:
    """Whether one of a header's columns holds the text."""
    return any(c.strip().lower() in {n.lower() for n in text_names} for c in header_names(header))


def with_text_name(names: tuple[str, ...], text_names: Sequence[str]) -> tuple[str, ...]:
    """Column names with the first that stands for the text as `text`; another column of that name becomes `text_other`."""
    wanted = {n.lower() for n in text_names}
    found = next((n for n in names if n.strip().lower() in wanted), None)
    if found is None:
        return names
    return tuple("text" if n == found else "text_other" if n.lower() == "text" else n for n in names)


def stored_records(spark: SparkSession, paths: str | Sequence[str], glob: str = "*", multiline: bool = True,
                   tolerant: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records of CSV files and the layout of each file (see `records`). With `multiline` the joined records are written once."""
    records = csv_records(csv_lines(spark, paths, glob, tolerant), multiline)
    return records, cut_lineage(file_layouts(records))


def read_by_header(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None, multiline: bool = True,
                   lineage: bool = False, tolerant: bool = False, text_names: Sequence[str] = (), glob: str = "*") -> DataFrame:
    """CSV files whose columns are named by each file's own header, all as text, missing-value tokens as null.

    All files are one scan; absent columns are null. `text_names` are names any of which stands for `text`; `columns` fixes the
    columns of the result, told apart without regard to case.
    """
    records, layouts = stored_records(spark, paths, glob, multiline, tolerant)
    return table_of(records, layouts, columns, lineage, text_names)


def table_of(records: DataFrame, layouts: DataFrame, columns: Sequence[str] | None = None, lineage: bool = False,
             text_names: Sequence[str] = ()) -> DataFrame:
    """Records as a table; see `read_by_header`. The distinct headers come to the driver, not the files."""
    headers = sorted(r.header for r in layouts.select("header").distinct().collect())
    if headers:
        table = parse_records(records, layouts, headers, lambda names: with_text_name(names, text_names))
    else:
        table = records.sparkSession.createDataFrame([], text_schema(columns or ["text"])).select(
            "*", *[F.lit("").alias(c) for c in ("_file", "_name")], *[F.lit(0).cast("long").alias(c) for c in ("_block", "_record")])
    present = {c.lower(): c for c in table.columns}
    own = [c for c in table.columns if c not in ("_file", "_name", "_block", "_record")] if columns is None else columns
    kept = [F.col(f"`{present[c.lower()]}`").alias(c) if c.lower() in present else F.lit(None).cast("string").alias(c) for c in own]
    if lineage:
        kept += [F.col("_name").alias("source_file"), F.col("_file").alias("source_path"),
                 F.struct(F.col("_file").alias("file"), F.col("_block").alias("block"), F.col("_record").alias("row")).alias("ingest_order")]
    return null_tokens(table.select(*kept))


def read_posts_csv(spark: SparkSession, paths: str | Sequence[str], schema: StructType | None = None,
                   multiline: bool = True, lineage: bool = True, glob: str | None = None,
                   tolerant: bool = False) -> DataFrame:
    """UTF-8 CSV files, each read by its own header, all columns as text, missing-value tokens as null.

    The text column becomes `text` whichever of its names a file uses; no data is read to infer types. A schema
    fixes the columns of the result. Large files are split over tasks; quoted newlines need `multiline`, which joins
    the lines of a record again and writes the records once: switch it off where posts hold none. `lineage` adds the
    file's name and path and the place of a row in the input (file, block of the file, record in it) as `source_file`, `source_path` and
    `ingest_order`. `tolerant` skips files that cannot be read instead of failing the run.
    """
    columns = None if schema is None else list(dict.fromkeys("text" if c.strip().lower() in fixed.TEXT_COLUMN_NAMES else c for c in schema.names))
    return read_by_header(spark, paths, columns, multiline, lineage, tolerant, fixed.TEXT_COLUMN_NAMES, glob or "*")


def land(table: DataFrame, path: str) -> DataFrame:
    """Write a table read from CSV once as Parquet, which later reads split freely, and read it back."""
    table.write.mode("overwrite").parquet(path)
    return table.sparkSession.read.parquet(path)


def read_corpus(spark: SparkSession, path: str, schema: StructType | str, multiline: bool = True) -> DataFrame:
    """CSV corpus with typed columns, each file read by its own header. Values that do not fit a type are null."""
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    table = read_by_header(spark, path, wanted.names, multiline)
    return table.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted.fields])


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """(file, name, length) of the CSV files of a tree, without cleaned copies, logs and outputs.

    Only the listing is used: the content column is pruned, so no file is opened.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
             .load(root).select(F.col("path").alias("file"), "length"))
    name = F.element_at(F.split("file", "/"), -1)
    folder = F.regexp_replace("file", "/[^/]*$", "")
    return (files.withColumn("name", name)
            .where(~F.col("name").contains("_cleaned") & ~folder.contains("logs") & ~folder.contains("filtered_output"))
            .select("file", "name", "length"))


def read_shards(spark: SparkSession, folder: str, tolerant: bool = True, glob: str = fixed.SHARD_GLOB,
                multiline: bool = True) -> DataFrame:
    """All shards of fetched records, each by its own header; unreadable ones are skipped if tolerant."""
    return read_by_header(spark, folder, fixed.RECORD_COLUMNS, multiline, tolerant=tolerant, glob=glob)


def read_seen_ids(spark: SparkSession, folder: str, glob: str = fixed.SHARD_GLOB, multiline: bool = True) -> DataFrame:
    """Distinct ids of all shards, without their spreadsheet guard."""
    return read_shards(spark, folder, glob=glob, multiline=multiline).select(X.strip_guard(F.col("tweet_id")).alias("id")).where("id is not null").distinct()


def read_page_snapshots(spark: SparkSession, path: str, id_column: str = "page_id") -> DataFrame:
    """Stored pages: id, url, html."""
    return spark.read.parquet(path).select(id_column, "url", "html")
