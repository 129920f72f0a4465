"""Routed outputs, ledger, merged records, dead letters and analysis tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from narrascope import fixed_values as fixed
from narrascope.functions import text as X
from narrascope.functions.page import metric_or_na
from narrascope.operators.predicates import project_output
from narrascope.operators.rows import explode_rows
from narrascope.operators.windows import flag_duplicates
from narrascope.session import cut_lineage

ROUTE = ("category", "lang_bucket")
# The CSV writer would trim white space off every text by default.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def route(df: DataFrame) -> DataFrame:
    """One row per category of a post, with its output columns and route."""
    routed = explode_rows(df, "categories", "category")
    return project_output(routed, fixed.POST_COLUMNS + fixed.LINEAGE_COLUMNS + ROUTE)


def write_routed(df: DataFrame, path: str, mode: str = "append", rows_per_file: int = 5_000_000) -> None:
    """Append each post to the output of every category and language it belongs to.

    Matched rows are rebalanced by route before the write: adaptive execution splits a large route
    over tasks and merges small ones, so that files come out at the advisory size instead of one per
    input task and route.
    """
    routed = route(df).hint("rebalance", *ROUTE)
    routed.write.mode(mode).partitionBy(*ROUTE).option("maxRecordsPerFile", rows_per_file).parquet(path)


def ensure_outputs(df: DataFrame, path: str, categories: Sequence[str], buckets: Sequence[str] = ("en", "ru", "other")) -> None:
    """An empty table for each category and language, so that readers find every output before its first match."""
    kinds = route(df).schema
    fields = StructType([f for f in kinds.fields if f.name not in ROUTE])
    for category in categories:
        for bucket in buckets:
            df.sparkSession.createDataFrame([], fields).write.mode("append").parquet(
                f"{path}/category={category}/lang_bucket={bucket}")


def append_ledger(tally: DataFrame, path: str) -> None:
    tally.select("file", "total", "matched", "duplicates", "multi_category").write.mode("append").parquet(path)


def spreadsheet_safe(records: DataFrame) -> DataFrame:
    """Guarded ids, link formulas and `N/A` metrics, for hand-off as CSV."""
    plain = X.strip_guard(F.col("tweet_id"))
    table = records.withColumn("URL", X.sheet_link(plain)).withColumn("tweet_id", X.guard_id(plain))
    for metric in fixed.METRIC_TESTIDS:
        if metric in table.columns:
            table = table.withColumn(metric, metric_or_na(F.col(metric)))
    return table


def finished_dates(spark: SparkSession, path: str) -> DataFrame:
    """(source_date) of the dates that have output below a path. Only the listing is read."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    except AnalysisException:
        return spark.createDataFrame([], "source_date string")
    return files.select(F.url_decode(F.regexp_extract("path", "/source_date=([^/]+)/", 1)).alias("source_date")).where(
        "source_date != ''").distinct()


def write_merged(records: DataFrame, path: str, one_file: bool = False, redo: bool = False) -> None:
    """Merged records as CSV per input date; a single file per run only for a small hand-off.

    Dates that have output already are left as they are; with `redo` those among the records are replaced. Other
    dates' output always stays.
    """
    if not redo:
        # Read before the write, which would change it.
        done = [r.source_date for r in finished_dates(records.sparkSession, path).collect()]
        records = records.where(~F.coalesce(F.col("source_date").cast("string").isin(done), F.lit(False)))
    table = records.coalesce(1) if one_file else records.hint("rebalance", "source_date")
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_date").options(
        **CSV_OPTIONS).csv(path)


def deduplicate_in_place(spark: SparkSession, path: str, key: str, order: Sequence[str], outputs: Sequence[str] = ROUTE) -> int:
    """Keep the first row per key in each output of a partitioned table; gives the number of partitions that changed.

    `order` has to tell the rows of an output apart. Only partitions that hold a later row of a key are written again, so
    the files of all others stay as they are; a partition that keeps no row is deleted. Null keys are no repeats.
    """
    read = spark.read.option("mergeSchema", True).parquet(path)
    some = read.select(F.col("_metadata.file_path").alias("f")).first()
    if some is None:
        return 0
    # Partition columns stand in the path of any file, its folder in that of its own.
    by = [p.split("=")[0] for p in some.f.split("/")[:-1] if "=" in p and p.split("=")[0] in read.columns]
    rows = read.select("*", F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("_folder"))
    flagged = flag_duplicates(rows.where(F.col(key).isNotNull()), [*outputs, key], [*order, *outputs])
    counts = flagged.groupBy(*by, "_folder").agg(F.count_if("is_duplicate").alias("later")).where("later > 0").select(*by, "_folder")
    # One row for each partition that changes.
    changed = cut_lineage(counts)
    if changed.isEmpty():
        return 0
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    hit = F.broadcast(changed.select(*[F.col(c).alias(f"_{c}") for c in by]))
    kept = flagged.where(~F.col("is_duplicate")).select(*read.columns).unionByName(rows.where(F.col(key).isNull()).select(*read.columns))
    kept = cut_lineage(kept.join(hit, same, "left_semi"))
    kept.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    left = kept.select(*[F.col(c).alias(f"_{c}") for c in by]).distinct()
    for row in changed.join(left, same, "left_anti").collect():
        folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(row["_folder"]))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return changed.count()


def write_dead_letters(failed: DataFrame, path: str) -> None:
    failed.select("id", "reason").write.mode("append").parquet(path)


def recovery_list(failed: DataFrame) -> DataFrame:
    """Distinct failed ids in text order. Skipped ids are not failures."""
    return failed.select("id").distinct().orderBy("id")


def failure_lines(failed: DataFrame) -> DataFrame:
    return failed.select(F.concat_ws(fixed.FAILURE_SEPARATOR, "id", "reason").alias("value"))


def write_analysis_tables(tables: dict[str, DataFrame], path: str, csv: bool = False) -> None:
    """One Parquet table per name; with `csv` also one CSV table, arrays as text."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
        if csv:
            kinds = dict(table.dtypes)
            flat = table.select(*[F.array_join(c, ", ").alias(c) if kinds[c].startswith("array<string") else
                                  F.col(c).cast("string").alias(c) for c in table.columns])
            flat.write.mode("overwrite").options(**CSV_OPTIONS).csv(f"{path}/{name}_csv")
