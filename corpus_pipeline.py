"""The corpus pipeline: each stage works on all rows that the one before it kept.

Rows are neither sampled nor cut short, except for the texts that a classifier learns from (see `per_class` and
`per_language` of the operators). A stage handles null ids, texts, languages and sources, empty tables, repeated rows
and further columns: these come through unchanged up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.llm.bpe_transducer import bpe_query
from narrascope.llm.language_codes import fit_languages, identify_languages
from narrascope.llm.shingle_join import drop_near_duplicates
from narrascope.llm.source_mix import mixed_documents
from narrascope.llm.spark import remainder, write_table
from narrascope.llm.toxic_neighbours import fit_toxicity, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7. Without labels nothing is dropped."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    index = fit_toxicity(docs, labels.where(remainder(F.col("doc_id"), 3) != 1))
    return score_toxicity(docs, index, out="__toxicity").where("__toxicity.score < 0.7").select(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters and lies clearly nearer to one language than to any other."""
    learned = docs.select("lang", "text").where(remainder(F.col("doc_id"), 5) != 0)
    found = identify_languages(docs, fit_languages(learned), out="__language")
    return found.where("__language.lang_pred != 'und' and not __language.ambiguous").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them."""
    return mixed_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text of each row."""
    return bpe_query(docs)


STAGES = [("toxicity", drop_toxic), ("language", keep_known_languages), ("near_duplicates", keep_one_of_each_group),
          ("mixing", mix), ("tokens", tokenise)]
#: No SQL: toxicity and language are learned. The stages are tested against plain versions in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
