import time

import pytest
from pyspark.sql import functions as F

from narrascope import session as S


class Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default):
        return self.values.get(key, default)


class Context:
    def __init__(self, master):
        self.master, self.applicationId = master, "app-1"


class Session:
    def __init__(self, master, **values):
        self.conf, self.sparkContext = Conf(values), Context(master)


def test_shared_folder_comes_from_the_cluster():
    assert S.shared_dir(Session("spark://x", **{"spark.checkpoint.dir": "/shared/x/"})) == "/shared/x"
    with pytest.raises(ValueError):
        S.shared_dir(Session("spark://x"))
    local = Session("local[2]")
    assert S.shared_dir(local) == S.shared_dir(local)


def test_cut_lineage_keeps_rows_and_types(spark):
    df = spark.range(10).select("id", F.array(F.col("id")).alias("a"), F.struct(F.lit("x").alias("s")).alias("t"))
    cut = S.cut_lineage(df)
    assert cut.dtypes == df.dtypes and sorted(map(tuple, cut.collect())) == sorted(map(tuple, df.collect()))


def test_scratch_is_released(spark):
    S.release_scratch(spark)
    cut = S.cut_lineage(spark.range(5))
    assert cut.count() == 5 and S.release_scratch(spark) == 1 and S.release_scratch(spark) == 0


def test_shuffle_files_go_with_the_table(spark):
    def shuffled():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {name for name in (blocks.apply(i).name() for i in range(blocks.size())) if name.startswith("shuffle_")}

    before, key = shuffled(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    cut = S.cut_lineage(spark.range(100_000).repartition(3, "id").groupBy((F.col("id") % 1000).alias("k")).agg(F.sum("id").alias("n")))
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left and cut.count() == 1000 and spark.conf.get(key, None) == was
