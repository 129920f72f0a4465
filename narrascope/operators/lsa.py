"""Dense text vectors by a randomised singular value decomposition of TF-IDF rows (Halko, Martinsson and Tropp 2011).

Two passes over the rows. The first multiplies them with random columns and back, which gives a basis of the directions that matter; the
second sums the small matrix of products within that basis, whose eigenvectors turn it into the singular directions. What comes to
the driver has one row for each term of the vocabulary, a parameter, whatever the number of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.operators.rows import explode_rows
from narrascope.session import cut_lineage


#: Buckets that bound how many documents a term can be in.
BUCKETS = 1 << 18


def _frequent(docs: DataFrame, terms: str, features: int) -> DataFrame:
    """(term, df) of the `features` terms in most documents, and maybe others; exact.

    Counted by buckets first, so that rare terms are never shuffled: a term is in no more documents than its bucket has. The terms of the
    fullest buckets are counted, and those of all others that could still hold a term as frequent as the last of them.
    """
    each = explode_rows(docs.select(F.array_distinct(terms).alias("_t")), "_t", "term").withColumn(
        "_bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    sizes = cut_lineage(each.groupBy("_bucket").agg(F.count("*").alias("_most")))

    def counted(buckets: DataFrame) -> DataFrame:
        # At most BUCKETS numbers.
        return each.join(F.broadcast(buckets.select("_bucket")), "_bucket").groupBy("term").agg(F.count("*").alias("df"))

    fullest = sizes.orderBy(F.desc("_most"), "_bucket").limit(2 * features)
    found = cut_lineage(counted(fullest))
    last = found.orderBy(F.desc("df")).limit(features).agg(F.count("*").alias("n"), F.min("df").alias("df")).first()
    least = last.df if last.n >= features else 0
    left = sizes.join(fullest.select("_bucket"), "_bucket", "left_anti").where(F.col("_most") >= least)
    return found if left.isEmpty() else found.unionByName(counted(left))


def fit_vocabulary(docs: DataFrame, terms: str = "terms", features: int = 1 << 14) -> DataFrame:
    """(term, place, idf) of the terms in most documents, ties by the term; idf is ln((1 + documents) / (1 + df)) + 1."""
    total = docs.agg(F.count("*")).scalar()
    counts = _frequent(docs, terms, features)
    kept = counts.orderBy(F.desc("df"), "term").limit(features).select("term", (F.ln((1.0 + total) / (1.0 + F.col("df"))) + 1.0).alias("idf"), "df")
    # As many rows as there are features.
    rows = sorted(kept.collect(), key=lambda r: (-r.df, r.term))
    return cut_lineage(docs.sparkSession.createDataFrame([(r.term, i, r.idf) for i, r in enumerate(rows)], "term string, place int, idf double"))


def term_rows(docs: DataFrame, vocabulary: DataFrame, id_column: str = "doc_id", terms: str = "terms") -> DataFrame:
    """(id, places, weights): the TF-IDF row of each document with a known term, sparse. Unknown terms are dropped before anything moves."""
    known = explode_rows(docs.select(id_column, terms), terms, "term", id_column).join(F.broadcast(vocabulary), "term")
    weighed = known.groupBy(id_column, "place").agg((F.count("*") * F.first("idf")).alias("w"))
    rows = weighed.groupBy(id_column).agg(F.sort_array(F.collect_list(F.struct("place", "w"))).alias("e"))
    return rows.select(id_column, F.col("e.place").alias("places"), F.col("e.w").alias("weights"))


@dataclass
class SingularDirections:
    """`basis` holds a singular direction of the terms in each column, by falling singular value."""

    basis: np.ndarray
    values: np.ndarray

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, row.tolist()) for i, row in enumerate(self.basis)] + [(-1, self.values.tolist())]
        spark.createDataFrame(rows, "place int, v array<double>").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> SingularDirections:
        rows = sorted((r.place, r.v) for r in spark.read.parquet(path).collect())
        return SingularDirections(np.array([v for _, v in rows[1:]]).reshape(len(rows) - 1, -1), np.array(rows[0][1]))


def _sum_rows(parts: DataFrame, key: str) -> dict[int, np.ndarray]:
    """Sum of the vectors (key, v) of each key; combined before they move."""
    sums = parts.select(key, array_to_vector("v").alias("v")).groupBy(key).agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("v"))
    return {r[0]: np.array(r[1]) for r in sums.collect()}


def fit_directions(rows: DataFrame, features: int, k: int = 64, more: int = 10, seed: int = 0) -> SingularDirections:
    """The first k singular directions of the rows (places, weights) over `features` terms.

    `more` further random columns make up for the directions that k alone would miss; with k + more not below the rank the result is that
    of a full decomposition.
    """
    width = min(features, k + more)
    sparse = rows.select("places", "weights")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        random, sums = np.random.default_rng(seed).normal(size=(features, width)), np.zeros((features, width))
        touched = np.zeros(features, bool)
        for batch in batches:
            for places, weights in zip(batch["places"], batch["weights"]):
                sums[places] += np.outer(weights, weights @ random[places])
                touched[places] = True
        at = np.flatnonzero(touched)
        if len(at):
            yield pd.DataFrame({"place": at.astype(np.int32), "v": list(sums[at])})

    found = _sum_rows(sparse.mapInPandas(spread, "place int, v array<double>"), "place")
    reached = np.zeros((features, width))
    for place, row in found.items():
        reached[place] = row
    basis = np.linalg.qr(reached)[0]
    sent = rows.sparkSession.sparkContext.broadcast(basis)  # features x width

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            inside = np.array([weights @ sent.value[places] for places, weights in zip(batch["places"], batch["weights"])]).reshape(-1, width)
            total += inside.T @ inside
        yield pd.DataFrame({"line": np.arange(width, dtype=np.int32), "v": list(total)})

    lines = _sum_rows(sparse.mapInPandas(products, "line int, v array<double>"), "line")
    small = np.array([lines.get(i, np.zeros(width)) for i in range(width)])
    squares, turn = np.linalg.eigh(small)
    order = np.argsort(squares)[::-1][:k]
    return SingularDirections(basis @ turn[:, order], np.sqrt(np.maximum(squares[order], 0)))


def embed_rows(rows: DataFrame, directions: SingularDirections, to: str = "embedding", unit: bool = True) -> DataFrame:
    """Add the dense vector of each row; of unit length, unless the row has nothing along the directions."""
    sent = rows.sparkSession.sparkContext.broadcast(directions.basis)

    def run(places: pd.Series, weights: pd.Series) -> pd.Series:
        out = []
        for p, w in zip(places, weights):
            v = w @ sent.value[p]
            size = np.sqrt(v @ v)
            out.append(v / size if unit and size > 0 else v)
        return pd.Series(out)

    run.__annotations__ = {"places": pd.Series, "weights": pd.Series, "return": pd.Series}
    return rows.withColumn(to, F.pandas_udf(run, "array<double>")("places", "weights"))
