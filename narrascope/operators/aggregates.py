"""Counts, shares and tallies. All aggregates combine map side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.functions import text as X
from narrascope.operators.rows import explode_rows


def value_counts(df: DataFrame, column: str, n: str = "n") -> DataFrame:
    """Count per value, blanks left out, largest first."""
    value = F.col(column)
    counts = df.where(value.isNotNull() & (value.cast("string") != "")).groupBy(column).agg(F.count("*").alias(n))
    return counts.orderBy(F.desc(n), column)


def counts_as_map(counts: DataFrame, column: str, n: str = "n", to: str = "counts") -> DataFrame:
    """One row with a map value -> count, for columns of few values such as languages or reasons."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(column).alias("k"), F.col(n).alias("v"))))
    return counts.agg(F.map_from_entries(pairs).alias(to))


def summary_text(counts: Column, title: str) -> Column:
    parts = F.transform(F.map_entries(counts), lambda e: F.concat(F.lit("'"), e["key"], F.lit("': "), e["value"].cast("string")))
    return F.concat(F.lit(f"{title}: {{"), F.array_join(parts, ", "), F.lit("}"))


def run_summary(records: DataFrame) -> DataFrame:
    """One row: counts of languages and of failures, as maps and as one line of text. One pass over the records."""
    kinds = {"language_counts": "language", "failure_counts": "fail_reason"}
    values = F.array(*[F.struct(F.lit(to).alias("kind"), F.col(c).cast("string").alias("value")) for to, c in kinds.items()])
    counts = (explode_rows(records.select(*kinds.values()), values, "p").select("p.*").where("value is not null and value != ''")
              .groupBy("kind", "value").agg(F.count("*").alias("n")))
    row = counts.agg(*[F.map_from_entries(F.array_sort(F.collect_list(
        F.when(F.col("kind") == to, F.struct(F.col("value").alias("k"), F.col("n").alias("v")))))).alias(to) for to in kinds])
    return row.withColumn("summary", F.concat_ws(" | ", summary_text(F.col("language_counts"), "Languages"),
                                                 summary_text(F.col("failure_counts"), "Failures")))


def status_buckets(status: DataFrame, code: str = "status_code", text: str = "status_text") -> DataFrame:
    """One row: how many ids are live, gone, blocked, timed out or other."""
    c, t = F.col(code), F.col(text)
    table = status.agg(
        F.count("*").alias("total"), F.count_if(c == 200).alias("ok_200"), F.count_if(c == 404).alias("gone_404"),
        F.count_if(c == 403).alias("blocked_403"), F.count_if(t == "timeout").alias("timeout"))
    rest = F.col("total") - F.col("ok_200") - F.col("gone_404") - F.col("blocked_403") - F.col("timeout")
    return table.withColumn("other", rest)


def file_tally(df: DataFrame, file: str = "source_file") -> DataFrame:
    """Per file: rows, rows with a category, rows with several."""
    return df.groupBy(F.col(file).alias("file")).agg(
        F.count("*").alias("total"),
        F.count_if(F.size("categories") > 0).alias("matched"),
        F.sum(F.lit(0).cast("long")).alias("duplicates"),
        F.count_if("multi_category_match").alias("multi_category"))


def with_match_rate(tally: DataFrame, matched: str = "matched", total: str = "total") -> DataFrame:
    rate = X.ratio_or_zero(F.col(matched), F.col(total))
    return tally.withColumn("match_rate", rate).withColumn("match_rate_text", X.percent_text(rate))


def run_tally(tally: DataFrame) -> DataFrame:
    """One row of totals over all files, with the match rate."""
    columns = ("total", "matched", "duplicates", "multi_category")
    sums = tally.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])
    return with_match_rate(sums)


def label_shares(df: DataFrame, topic: str, label: str, labels: Sequence[str]) -> DataFrame:
    """Share of each label per topic, one column per label, 0 where it is missing, by topic."""
    counts = df.where(F.col(label).isNotNull()).groupBy(topic).agg(
        F.count("*").alias("_n"), *[F.count_if(F.col(label) == v).alias(v) for v in labels])
    return counts.select(topic, *[(F.col(v) / F.col("_n")).alias(v) for v in labels]).orderBy(topic)


def topic_counts(df: DataFrame, topic: str = "topic") -> DataFrame:
    return df.groupBy(topic).agg(F.count("*").alias("count"))


def distinct_ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.select(key).distinct()


def dedup_report(df: DataFrame, groups: Sequence[str], key: str) -> DataFrame:
    """Rows before and after dedup per output, by two rounds of plain counting."""
    per_key = df.groupBy(*groups, key).agg(F.count("*").alias("_n"))
    return per_key.groupBy(*groups).agg(F.sum("_n").alias("before"), F.count("*").alias("after"))


def category_grid(counts: DataFrame, categories: Sequence[str], buckets: Sequence[str], n: str = "n") -> DataFrame:
    """Every category with every language bucket, 0 where nothing was counted."""
    grid = counts.sparkSession.createDataFrame([(c, b) for c in categories for b in buckets],
                                               "category string, lang_bucket string")
    return grid.join(counts, ["category", "lang_bucket"], "left").na.fill(0, [n])
