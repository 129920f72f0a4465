"""Session settings and the shared folder for intermediate data."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "narrascope", master: str | None = None, **settings: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow on. `master` is for local runs only."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster in `spark.checkpoint.dir`.

    Only where that is unset (a local test session) a temporary folder is made, once per application.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        if context.applicationId not in _LOCAL_DIRS:
            _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="narrascope-")
        named = _LOCAL_DIRS[context.applicationId]
    return named.rstrip("/")


#: Paths given out by this process, by application.
_GIVEN: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _GIVEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def keep_scratch(spark: SparkSession) -> None:
    """Leave what has been written so far out of the next release."""
    _GIVEN.pop(spark.sparkContext.applicationId, None)


def release_scratch(spark: SparkSession) -> int:
    """Delete what this process has written to its scratch paths; call it once results are stored. Gives their number."""
    context, count = spark.sparkContext, 0
    for name in _GIVEN.pop(context.applicationId, []):
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        count += bool(path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True))
    return count


#: Whether the shuffle files of a run are deleted as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_once(df: DataFrame, path: str) -> None:
    """Write a table. The shuffle files behind it go as soon as it is there; else they stay until the driver happens to collect its
    garbage, and the disk holds those of all steps so far."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(_CLEANUP)
        else:
            conf.set(_CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table below the shared folder and read it back.

    Like a reliable checkpoint it survives the loss of executors; being Parquet, it is also read by
    column and has a known size, so that later joins are planned well.
    """
    path = scratch_path(df.sparkSession, "table")
    write_once(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
