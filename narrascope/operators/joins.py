"""Probes against id sets and status tables, as joins. The planner picks the join strategy."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def anti_seen(ids: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    """Ids not seen before."""
    return ids.join(seen.select(key), key, "left_anti")


def seen_table(spark: SparkSession, path: str, buckets: int = 200, key: str = "id") -> str:
    """Name of the table of seen ids below a path, made where it is not there: hashed into buckets, each sorted by id.

    The files carry their bucket's number, so a later session registers the same path and goes on. The number of buckets is that of
    the first call for a path and must be given again.
    """
    name = "seen_" + hashlib.sha256(f"{path.rstrip('/')} {key} {buckets}".encode()).hexdigest()[:24]
    quoted = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (`{key}` STRING) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
              f"INTO {int(buckets)} BUCKETS LOCATION '{quoted}'")
    return name


def add_seen(ids: DataFrame, name: str, key: str = "id", buckets: int = 200) -> None:
    """Append the ids that are not in the table of seen ids yet, each once. Only the new ids move."""
    new = anti_seen_table(ids.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull()).distinct(), name, key, buckets)
    # A task for each bucket, so that a run adds one file to a bucket.
    new.repartition(buckets, key).write.insertInto(name)


def anti_seen_table(ids: DataFrame, name: str, key: str = "id", buckets: int = 200) -> DataFrame:
    """Rows whose id is not in the table of seen ids. The ids are dealt out like its buckets, which are read as they lie."""
    seen = ids.sparkSession.table(name).select(F.col(key).alias("_seen"))
    asked = ids.repartition(buckets, F.col(key).cast("string"))
    return asked.join(seen.hint("merge"), asked[key].cast("string") == F.col("_seen"), "left_anti")


def status_lookup(ids: DataFrame, status: DataFrame, key: str = "id") -> DataFrame:
    """Ids with their status, null where unknown."""
    return ids.join(status, key, "left")


def unavailable(df: DataFrame, code: int = 404) -> DataFrame:
    return df.where(F.col("status_code") == code)


def split_skipped(ids: DataFrame, seen: DataFrame, status: DataFrame, key: str = "id", code: int = 404) -> DataFrame:
    """Ids with `skip_reason`: `unavailable`, `seen`, or null for those still to fetch."""
    marked = (ids.join(status.select(key, "status_code"), key, "left")
                 .join(seen.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left"))
    reason = F.when(F.col("status_code") == code, "unavailable").when(F.col("_seen"), "seen")
    return marked.withColumn("skip_reason", reason).drop("_seen")


def anti_processed_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    return files.join(ledger.select("file"), "file", "left_anti")


def attach(df: DataFrame, *others: DataFrame, key: str = "doc_id") -> DataFrame:
    """Columns of other tables, row by row, by id."""
    for other in others:
        df = df.join(other, key)
    return df
