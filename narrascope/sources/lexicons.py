"""Lexicon files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.operators.lexicon import _NO_SPACES_SCRIPT


def read_lexicon(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(category, priority, keyword, match_mode) from blocks: category line, keywords line, blank line."""
    block = F.split(F.trim("block", F.lit("\r\n ")), r"\r?\n", 2)
    text = spark.read.text(path, wholetext=True)
    blocks = text.select(F.posexplode(F.split(F.trim("value", F.lit("\r\n ")), r"\r?\n\s*\r?\n")).alias("priority", "block"))
    words = blocks.select("priority", F.trim(F.get(block, F.lit(0))).alias("category"),
                          F.explode(F.split(F.coalesce(F.get(block, F.lit(1)), F.lit("")), separator)).alias("keyword"))
    words = words.withColumn("keyword", F.trim("keyword", F.lit("\r\n "))).where("keyword != ''")
    mode = F.when(F.col("keyword").rlike(_NO_SPACES_SCRIPT.pattern), "substring").otherwise("word")
    return words.select("category", "priority", "keyword", mode.alias("match_mode"))
