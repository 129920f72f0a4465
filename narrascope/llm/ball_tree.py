"""Exact top-k search by inner product with ball trees and branch and bound (Ram and Gray 2012).

Each shard of the vectors is a ball tree. A node's inner product with a query is at most that of its center plus radius
times the query's length. A first pass opens only the most promising leaf of every shard, and the k-th best score
that all shards reach together is then shared with the second pass, which opens a node only while its bound is not
below the best k-th score known, from all shards or its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrascope.llm.spark import write_table

LEAF = 64
#: Vectors of a shard and queries of a block.
SHARD, BLOCK = 4096, 512


class BallTree:
    """Points in leaves of at most LEAF, each leaf and inner node with the ball around its points.

    A node is split at the median along its widest coordinate, so equal points make a balanced tree too.
    """

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.points = points
        self.start, self.end, self.left, self.right = [], [], [], []
        self.center, self.radius = [], []
        if len(points):
            self._build(0, len(points))
        self.points = points[self.order]
        self.center, self.radius = np.array(self.center), np.array(self.radius)

    def _build(self, start: int, end: int) -> int:
        own, node = self.points[self.order[start:end]], len(self.start)
        center = own.mean(0)
        self.start.append(start)
        self.end.append(end)
        self.left.append(-1)
        self.right.append(-1)
        self.center.append(center)
        # Slightly too large, so that rounding never cuts off a point.
        self.radius.append(np.sqrt(((own - center) ** 2).sum(1).max()) * (1 + 1e-9) + 1e-9)
        if end - start > LEAF:
            axis, half = int(np.argmax(own.max(0) - own.min(0))), (end - start) // 2
            self.order[start:end] = self.order[start:end][np.argpartition(own[:, axis], half)]
            self.left[node] = self._build(start, start + half)
            self.right[node] = self._build(start + half, end)
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product of each query with each node's points."""
        size = np.sqrt((queries ** 2).sum(1))
        return (queries @ self.center.T + size[:, None] * self.radius[None, :]) * (1 + 1e-12) + 1e-6


def top_k(tree: BallTree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, known: np.ndarray,
          first_leaf: bool) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Per query (its number, ids, scores) of its best k points at least as good as its known k-th score.

    Equal scores go to the smaller id. `ids` are in the tree's order. `first_leaf` opens one leaf only.
    """
    found, bounds = [], tree.bounds(queries)
    for q in range(len(queries)):
        best_ids, best = np.empty(0, np.int64), np.empty(0)
        floor, heap = known[q], [0] if len(tree.start) else []
        while heap:
            node = heap.pop()
            if bounds[q, node] < floor:
                continue
            if tree.left[node] >= 0:
                # The better child is opened first.
                heap += sorted((tree.left[node], tree.right[node]), key=lambda c: bounds[q, c])
                continue
            part = slice(tree.start[node], tree.end[node])
            scores, own = tree.points[part] @ queries[q], ids[part]
            use = (own != query_ids[q]) & (scores >= floor)
            best_ids, best = np.concatenate((best_ids, own[use])), np.concatenate((best, scores[use]))
            if len(best) > k:
                order = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[order], best[order]
            if len(best) == k:
                floor = max(floor, best.min())
            if first_leaf:
                break
        found.append((q, best_ids, best))
    return found


def _search(dealt: DataFrame, k: int, first_leaf: bool) -> DataFrame:
    """Candidates (query_id, vec_id, score) of each (shard, block): rows that have kind 0 are its vectors, others queries."""
    def search(rows: pd.DataFrame) -> pd.DataFrame:
        stored, asked = rows[rows["kind"] == 0], rows[rows["kind"] == 1]
        out: list[pd.DataFrame] = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")]
        if len(stored) and len(asked):
            tree = BallTree(np.stack(stored["x"].to_list()).astype(np.float64))
            ids, query_ids = stored["vec_id"].to_numpy()[tree.order], asked["vec_id"].to_numpy()
            queries, known = np.stack(asked["x"].to_list()).astype(np.float64), asked["known"].to_numpy()
            for q, own, scores in top_k(tree, ids, queries, query_ids, k, known, first_leaf):
                out.append(pd.DataFrame({"query_id": query_ids[q], "vec_id": own, "score": scores.astype(np.int64)}))
        return pd.concat(out)

    return dealt.groupBy("dims", "shard", "block").applyInPandas(search, "query_id long, vec_id long, score long")


def _best(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of vectors (vec_id, x array<long>) for each query row.

    The score is the inner product; rows with the query's own vec_id are left out; equal scores go to the smaller
    vec_id. Only vectors of the query's length are candidates. Null vectors and ids, and empty vectors, take no part.
    Every query meets every shard: the queries are dealt out in blocks, once to each shard. Rows repeated in full are as many
    candidates, and one query. Scores are exact below 2^53.
    """
    # Repeated rows move once, with their number; more than k of them cannot be listed.
    usable, _ = write_table(vectors.where("vec_id is not null and x is not null and size(x) > 0").select(
        "vec_id", "x", is_query.alias("asks"), F.size("x").alias("dims")).groupBy("vec_id", "x", "asks", "dims").agg(
        F.least(F.count("*"), F.lit(k)).cast("int").alias("copies")), "vectors")
    counts = usable.agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("int")).alias("q")).first()
    shards, blocks = max(1, -(-counts.n // SHARD)), max(1, -(-(counts.q or 0) // BLOCK))
    place = F.xxhash64("vec_id", "x")
    stored = usable.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("vec_id", "x", "dims", F.lit(0).alias("kind"), F.lit(float("-inf")).alias("known"),
                           F.pmod(place, F.lit(shards)).cast("int").alias("shard"),
                           F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def asked(queries: DataFrame) -> DataFrame:
        return stored.unionByName(queries.select(
            "vec_id", "x", "dims", F.lit(1).alias("kind"), "known",
            F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
            F.pmod(F.xxhash64("x", "vec_id"), F.lit(blocks)).cast("int").alias("block")))

    queries = usable.where("asks").select("vec_id", "x", "dims")
    first = _best(_search(asked(queries.withColumn("known", F.lit(float("-inf")))), k, True), k)
    shared, _ = write_table(first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("known")), "shared")
    known = queries.join(shared, "vec_id", "left").withColumn("known", F.coalesce("known", F.lit(float("-inf"))))
    # A vector stands in one shard, so it is found once for each query; equal ids can stand in several.
    return _best(_search(asked(known), k, False), k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, x) with x the floor of `scale` times each component; vectors with a null or non-finite one become null."""
    parts = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists(parts, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select("vec_id", F.when(~bad, F.transform(parts, lambda v: F.floor(v * scale))).alias("x"))


def search_query(vectors: DataFrame) -> DataFrame:
    """The contract of op5."""
    return search_top_k(quantised(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")),
                        F.col("vec_id") % 50 == 0)


SEARCH_SQL = """
WITH parts AS (
  SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5
"""
