"""Small helpers on Spark frames: scoring a text column, bounded samples, tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from narrascope.session import scratch_path, write_once

#: Rows of an Arrow batch. Texts can be long, so a batch of the default size could outgrow a worker.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches of `BATCH_ROWS`."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def remainder(column: Column, base: int) -> Column:
    """crc32 of an id as text, modulo `base`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % base


def with_scores(df: DataFrame, text: str, out: str, make: Callable[[], Callable[[str | None], tuple[Any, ...]]],
                schema: str) -> DataFrame:
    """Add a struct column computed from each text by the function that `make` builds once per task.

    Only the text column goes through Python. The function is declared non-deterministic so that the planner
    evaluates it once even where a filter on its result follows.
    """
    small_batches(df.sparkSession)
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = make()
        for texts in batches:
            yield pd.DataFrame([score(t) for t in texts], columns=names)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return df.withColumn(out, F.pandas_udf(run, schema).asNondeterministic()(df[text]))


def class_counts(df: DataFrame, label: str) -> dict[Any, int]:
    """Rows of each non-null label. As many entries as there are classes."""
    return {r[0]: r[1] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}


def _drawn(label: str, key: Column, counts: dict[Any, int], per_class: int) -> Column:
    """Whether a hash of the key falls within the share that makes about `per_class` rows of each class."""
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_class / n))).otherwise(share)
    return F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share


def bounded_sample(df: DataFrame, label: str, text: str, counts: dict[Any, int], per_class: int) -> DataFrame:
    """(label, text) of about `per_class` rows of each class, drawn by a hash of the text, so that reruns agree.

    A class with fewer rows is taken whole. Copies of a text are drawn together, so a class made of few texts can
    go over or under the figure; texts are made distinct, which keeps the sample bounded even then.
    """
    return df.where(F.col(label).isNotNull() & F.col(text).isNotNull() & _drawn(label, F.col(text), counts, per_class)).select(
        label, text).distinct()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[Any, int]]:
    """(label, text) of about `per_class` distinct labelled texts of each of the classes 0 and 1, and the labels' counts.

    Ids are drawn from the label table, so only the drawn texts move: the drawn ids, at most about `per_class` for
    each class, are sent to the scan of docs. An id labelled twice takes its largest label; null ids and labels and
    texts, and other labels, take no part.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(
        F.max(label).cast("int").alias(label))
    counts = class_counts(own, label)
    drawn = own.where(_drawn(label, F.col("doc_id"), counts, per_class))
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id")
    return found.select(label, "text").distinct(), counts


def bounded_rows(df: DataFrame) -> pd.DataFrame:
    """The rows of a frame on the driver. For models only, whose size a parameter bounds."""
    return df.toArrow().to_pandas()


def write_table(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """Write a table below the shared folder; give what reads it, and its path for `drop_table`."""
    path = scratch_path(df.sparkSession, name)
    write_once(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that this run wrote and no longer reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
