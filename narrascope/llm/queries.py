"""The registered queries of this package: each applies one operator to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from narrascope.llm import (
    ball_tree,
    bpe_transducer,
    byte_ppm,
    fill_middle,
    language_codes,
    line_dedup,
    quality_svm,
    shallot,
    shingle_join,
    source_mix,
    toxic_neighbours,
    warc_index,
    winnowing,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _register(name: str, run: Callable[..., DataFrame], *tables: str, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(*(_table(spark, sf_dir, t) for t in tables))
    if sql is not None:
        ORACLES[name] = sql


_register("op1_language_codes", language_codes.language_query, "documents")
_register("op2_shingle_join", shingle_join.near_duplicate_query, "documents", sql="""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(
    range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS g FROM worded),
rows_ AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM rows_ a JOIN rows_ b ON a.s = b.s AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(r.y) AS component_id
FROM sets s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, s.g
""")
_register("op3_bpe_transducer", bpe_transducer.bpe_query, "documents")
_register("op4_winnowing", winnowing.fingerprint_query, "documents")
_register("op5_ball_tree", ball_tree.search_query, "embeddings", sql=ball_tree.SEARCH_SQL)
_register("op6_toxic_neighbours", toxic_neighbours.toxicity_query, "documents", "labels")
_register("op7_warc_index", warc_index.warc_query, "pages", sql=warc_index.WARC_SQL)
_register("op8_source_mix", source_mix.mix_query, "documents", sql=source_mix.MIX_SQL)
_register("op9_byte_ppm", byte_ppm.ppm_query, "documents")
_register("op10_quality_svm", quality_svm.quality_query, "documents", "labels")
_register("op11_displacement_scatter", fill_middle.fill_middle_query, "documents", sql=fill_middle.FILL_SQL)
_register("op12_line_bitmaps", line_dedup.line_dedup_query, "documents", sql=line_dedup.LINES_SQL)
_register("op13_shallot_search", shallot.cluster_query, "embeddings", sql=shallot.cluster_sql())
