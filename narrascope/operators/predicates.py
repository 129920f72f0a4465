"""Row filters, column selection and the corpus filters of the narrative analysis."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope import fixed_values as fixed
from narrascope.functions import text as X
from narrascope.functions.time import to_utc_timestamp


def find_column(df: DataFrame, names: Sequence[str]) -> str | None:
    """First column, in column order, whose trimmed lower-case name is among the names."""
    wanted = {n.lower() for n in names}
    return next((c for c in df.columns if c.strip().lower() in wanted), None)


def first_alias(df: DataFrame, names: Sequence[str]) -> str | None:
    """Column for the first of the names that is present."""
    return next((c for n in names if (c := find_column(df, [n]))), None)


def resolve_text_column(df: DataFrame, names: Sequence[str] = fixed.TEXT_COLUMN_NAMES) -> str:
    found = find_column(df, names)
    if found is None:
        raise ValueError(f"no text column among {df.columns}")
    return found


def rename_text(df: DataFrame, names: Sequence[str] = fixed.TEXT_COLUMN_NAMES) -> DataFrame:
    found = resolve_text_column(df, names)
    return df if found == "text" else df.withColumnRenamed(found, "text")


def fill_blank(df: DataFrame) -> DataFrame:
    """Nulls of all text columns become the empty text."""
    return df.na.fill("")


def null_tokens(df: DataFrame, tokens: Iterable[str] = fixed.NA_TOKENS) -> DataFrame:
    """Texts that stand for a missing value become null, in all text columns."""
    tokens = list(tokens)
    kinds = dict(df.dtypes)
    return df.select(*[F.when(~F.col(f"`{c}`").isin(tokens), F.col(f"`{c}`")).alias(c)
                       if kinds[c] == "string" else F.col(f"`{c}`") for c in df.columns])


def add_lineage(df: DataFrame, time_column: str = "tweetcreatedts") -> DataFrame:
    """`is_duplicate`; and, where there is a time column, its UTC value and the assumed zone."""
    df = df.withColumn("is_duplicate", F.lit(False))
    if time_column in df.columns:
        df = (df.withColumn(time_column, to_utc_timestamp(F.col(time_column)))
                .withColumn("timezone_assumed", F.lit("UTC")))
    return df


def add_lang_bucket(df: DataFrame, language: str = "language", to: str = "lang_bucket") -> DataFrame:
    """Bucket of the language; a missing language column counts as other."""
    source = F.col(language) if language in df.columns else F.lit(None).cast("string")
    return df.withColumn(to, X.lang_bucket(source))


def filter_language(df: DataFrame, keep: Iterable[str], names: Sequence[str] = fixed.LANGUAGE_COLUMN_NAMES) -> DataFrame:
    """Keep some languages; nothing happens if there is no language column."""
    column = next((n for n in names if n in df.columns), None)
    keep = [k.lower() for k in keep]
    return df if column is None or not keep else df.where(F.lower(F.col(column)).isin(keep))


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    return df.na.drop(subset=list(columns))


def drop_flagged_duplicates(df: DataFrame, names: Sequence[str] = fixed.DUPLICATE_FLAG_NAMES) -> DataFrame:
    column = first_alias(df, names)
    return df if column is None else df.where(~X.truthy_text(F.col(column)))


def is_repost(value: Column, count: Column | None = None, mode: str = "prefix_or_count") -> Column:
    """`RT ` in front or, unless mode is `prefix`, a repost count above 0."""
    found = X.starts_as_repost(value)
    if mode == "prefix_or_count" and count is not None:
        found = found | F.coalesce(count.cast("string").try_cast("double") > 0, F.lit(False))
    return found


def drop_reposts(df: DataFrame, text: str = "text", names: Sequence[str] = fixed.REPOST_COUNT_NAMES,
                 mode: str = "prefix_or_count") -> DataFrame:
    column = first_alias(df, names)
    return df.where(~is_repost(F.col(text), None if column is None else F.col(column), mode))


def min_length(df: DataFrame, column: str = "clean_text", chars: int = fixed.MIN_DOC_CHARS) -> DataFrame:
    return df.where(F.length(column) >= chars)


def declutter(df: DataFrame, text: str = "text", reason: str = "fail_reason", score: str = "hydration_score") -> DataFrame:
    """Blank the text of failed and low-score records; the score becomes a number."""
    df = (df.withColumn(score, X.int_or_zero(F.col(score)))
            .withColumn(reason, X.text_or_empty(F.col(reason))))
    bad = (X.strip(F.col(reason)) != "") | (F.col(score) <= fixed.LOW_SCORE)
    return df.withColumn(text, F.when(bad, "").otherwise(F.col(text)))


def project_output(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Just these columns, in this order; missing ones are null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
                       for c in dict.fromkeys(columns)])
