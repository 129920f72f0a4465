"""Batches that become visible all at once: tables written under a batch's own name, and one manifest that names it.

Every table of an output has a folder with a partition `batch=<name>` for each attempt. An attempt counts once its manifest is
there, which a rename within the file system creates at once and never over another. What a killed attempt left is never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

MANIFEST = "number long, batch string"


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder, by the JVM's file systems, so that any store works."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def manifests(spark: SparkSession, output: str) -> DataFrame:
    """(number, batch): a row for each committed batch."""
    files, where = _folder(spark, f"{output}/manifests")
    if not files.exists(where):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("pathGlobFilter", "*.json").json(f"{output}/manifests")


def new_batch() -> str:
    return uuid.uuid4().hex


def stage(df: DataFrame, output: str, table: str, batch: str, *by: str) -> None:
    """Write a batch's rows of a table, not to be seen yet."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(f"{output}/{table}/batch={batch}")


def commit(spark: SparkSession, output: str, batch: str) -> int:
    """Make a batch visible and give its number. Fails, and changes nothing, if another run has taken that number meanwhile."""
    last = manifests(spark, output).agg(F.max("number")).first()[0]
    number = 0 if last is None else last + 1
    files, folder = _folder(spark, f"{output}/manifests")
    files.mkdirs(folder)
    jvm = spark._jvm
    part, whole = (jvm.org.apache.hadoop.fs.Path(folder, name) for name in (f"_{batch}", f"{number:012d}.json"))
    stream = files.create(part, True)
    stream.write(bytearray(f'{{"number": {number}, "batch": "{batch}"}}\n', "utf-8"))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    never_over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context.rename(files.makeQualified(part), files.makeQualified(whole), never_over)
    return number


def read_committed(spark: SparkSession, output: str, table: str, schema: StructType | str | None = None) -> DataFrame:
    """The rows of a table in committed batches, with their `batch`. Folders of other batches are pruned, not read.

    Where no batch is there yet, the result is empty and has the columns of the schema, if one is given.
    """
    wanted = schema if isinstance(schema, StructType) or schema is None else StructType.fromDDL(schema)
    columns = None if wanted is None else StructType([*wanted.fields, StructField("batch", StringType())])
    try:
        reader = spark.read if columns is None else spark.read.schema(columns)
        rows = reader.option("basePath", f"{output}/{table}").option("mergeSchema", columns is None).parquet(f"{output}/{table}")
    except AnalysisException:
        return spark.createDataFrame([], columns or StructType([StructField("batch", StringType())]))
    return rows.withColumn("batch", F.col("batch").cast("string")).join(manifests(spark, output).select("batch"), "batch", "left_semi")


def drop_uncommitted(spark: SparkSession, output: str, *tables: str) -> int:
    """Delete what attempts without manifest left; only while no other run writes there. Gives the number of folders."""
    known, count = {r.batch for r in manifests(spark, output).select("batch").collect()}, 0
    for table in tables:
        files, where = _folder(spark, f"{output}/{table}")
        for status in files.listStatus(where) if files.exists(where) else []:
            name = status.getPath().getName()
            if name.startswith("batch=") and name.removeprefix("batch=") not in known:
                count += bool(files.delete(status.getPath(), True))
    return count
