"""Id lists, status maps, failure lists, ledger: small line formats, read by the text and CSV sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from narrascope import fixed_values as fixed
from narrascope.functions import text as X
from narrascope.functions.time import file_date
from narrascope.operators.windows import keep_first

LEDGER_SCHEMA = "file string, total long, matched long, duplicates long, multi_category long"


def list_id_files(spark: SparkSession, folder: str, glob: str = fixed.ID_LIST_GLOB) -> DataFrame:
    """(file, name, source_date) of the id lists by name. Only the listing is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select(F.col("path").alias("file"))
    name = F.element_at(F.split("file", "/"), -1)
    return files.select("file", name.alias("name"), file_date(name).alias("source_date")).orderBy("name")


def read_id_list(spark: SparkSession, path: str, glob: str = fixed.ID_LIST_GLOB) -> DataFrame:
    """(source_file, source_date, id, pos) of the id lists of a folder."""
    return read_id_lines(spark.read.option("pathGlobFilter", glob).text(path), F.col("_metadata.file_name"))


def read_id_lines(lines: DataFrame, name: Column) -> DataFrame:
    """(source_file, source_date, id, pos): distinct ids per list, in first-seen order.

    Lines that are not all digits are dropped, and everything from the end line on. Lists are read
    line by line, so that a long one is split over tasks: the position of a line is its file block
    and its number in the block, and the end line's position comes from an aggregate per file.
    """
    lines = lines.select(
        name.alias("source_file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("pos"),
        X.strip(F.col("value")).alias("id"))
    ends = lines.where(F.col("id") == fixed.ID_LIST_END).groupBy("source_file").agg(F.min("pos").alias("end"))
    ids = (lines.where(X.is_digits(F.col("id"))).join(ends, "source_file", "left")
           .where(F.col("end").isNull() | (F.col("pos") < F.col("end"))))
    firsts = keep_first(ids, ["source_file", "id"], ["pos"])
    return firsts.select("source_file", file_date(F.col("source_file")).alias("source_date"), "id", "pos")


def read_status_map(spark: SparkSession, path: str) -> DataFrame:
    """(id, status_code, status_text) from `id,status` lines, one row per id: of several lines the last one counts, by file and place."""
    rows = spark.read.schema("id string, status string").csv(path)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    placed = rows.select(X.strip(F.col("id")).alias("id"), "status", place.alias("place"))
    last = placed.groupBy("id").agg(F.max_by(F.struct("status"), "place").alias("s")).select("id", "s.status")
    code, word = X.int_or_text(X.strip(F.col("status")))
    return last.select("id", code.alias("status_code"), word.alias("status_text"))


def read_failures(spark: SparkSession, folder: str, glob: str = fixed.FAILURE_GLOB) -> DataFrame:
    """(id, reason) from failure lines."""
    parts = F.split(X.strip(F.col("value")), fixed.FAILURE_SEPARATOR, 2)
    rows = spark.read.option("pathGlobFilter", glob).text(folder)
    return rows.select(F.get(parts, F.lit(0)).alias("id"), F.get(parts, F.lit(1)).alias("reason")).where("id != ''")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger of processed files; empty where there is none yet."""
    try:
        rows = spark.read.schema(LEDGER_SCHEMA).parquet(path)
        return rows.select("file", "total", "matched", "duplicates", "multi_category")
    except AnalysisException:
        return spark.createDataFrame([], LEDGER_SCHEMA)
