"""Exact k-means of integer vectors by Shallot search (Borgelt 2020, Even Faster Exact k-Means Clustering).

Each vector remembers its nearest and second-nearest centroid, an upper bound on the distance to the first and a lower
bound on that to all others. While the first is below the second after the centroids moved, nothing is computed. Else the search
starts from the closer of the two remembered centroids and goes through its neighbours in order of distance; none beyond
the distance to the start plus that to the second best can matter, and this ball shrinks whenever the second best gets
closer. Bounds are floating-point numbers with some slack; what they leave is compared in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from narrascope.llm.spark import drop_table, write_table

#: Vectors that are searched together.
BLOCK = 8192
#: Components of at most this size have squared distances within 64 bits for up to 64 components and more; larger ones are
#: compared as unbounded integers.
SMALL = 1 << 27
LARGEST = (1 << 63) - 1
_SLACK = 1e-9
_STATE = "first int, second int, upper double, lower double, distance long"


class Centroids:
    """k centroids with the order of their neighbours and how far each moved since the last round."""

    def __init__(self, points: np.ndarray, before: Centroids | None = None):
        self.points, self.k = points, len(points)
        between = np.sqrt(_squares(points[:, None, :] - points[None, :, :]).astype(float))
        self.near = np.argsort(between, axis=1, kind="stable")
        self.gap = np.take_along_axis(between, self.near, 1)
        others = between + np.where(np.eye(self.k, dtype=bool), np.inf, 0)
        self.half = others.min(1) / 2 * (1 - _SLACK) if self.k > 1 else np.full(1, np.inf)
        moved = np.zeros(self.k) if before is None else np.sqrt(_squares(points - before.points).astype(float)) * (1 + _SLACK)
        self.moved = moved
        # The farthest move among the centroids other than one's own.
        self.moved_other = np.array([np.delete(moved, j).max() if self.k > 1 else 0.0 for j in range(self.k)])

    def digest(self, j: int) -> str:
        return hashlib.sha256(",".join(str(int(v)) for v in self.points[j]).encode()).hexdigest()


def _squares(differences: np.ndarray) -> np.ndarray:
    return (differences * differences).sum(-1)


def search(x: np.ndarray, centroids: Centroids, first: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray,
           exact: bool) -> tuple[np.ndarray, ...]:
    """The nearest centroid of each vector (ties: the smaller number), with what is remembered and its squared distance.

    The distance of a vector whose bounds settle it is -1 unless `exact` asks for all.
    """
    points, distance = centroids.points, np.full(len(x), -1, dtype=x.dtype)
    first, second = first.copy(), second.copy()
    if centroids.k == 1:
        return first, second, upper, lower, _squares(x - points[0])
    upper, lower = upper + centroids.moved[first], lower - centroids.moved_other[first]
    limit = np.maximum(lower, centroids.half[first])
    open_ = np.flatnonzero(upper >= limit)
    if len(open_):
        # A tight upper bound settles many of the rest.
        distance[open_] = _squares(x[open_] - points[first[open_]])
        upper[open_] = np.sqrt(distance[open_].astype(float)) * (1 + _SLACK)
        open_ = open_[upper[open_] >= limit[open_]]
    if len(open_):
        rows = x[open_]
        best, other, d1 = first[open_], second[open_], distance[open_]
        d2 = _squares(rows - points[other])
        swap = (d2 < d1) | ((d2 == d1) & (other < best))
        best, other, d1, d2 = (np.where(swap, b, a) for a, b in ((best, other), (other, best), (d1, d2), (d2, d1)))
        start, reach = best.copy(), np.sqrt(d1.astype(float))
        for c in np.unique(start):
            live = np.flatnonzero(start == c)
            for j, gap in zip(centroids.near[c], centroids.gap[c]):
                if j == c:
                    continue
                live = live[gap <= (reach[live] + np.sqrt(d2[live].astype(float))) * (1 + _SLACK) + _SLACK]
                if not len(live):
                    break
                d = _squares(rows[live] - points[j])
                ahead = (d < d1[live]) | ((d == d1[live]) & (j < best[live]))
                between = ~ahead & (j != best[live]) & (d < d2[live])
                a, b = live[ahead], live[between]
                other[a], d2[a], best[a], d1[a] = best[a], d1[a], j, d[ahead]
                other[b], d2[b] = j, d[between]
        first[open_], second[open_], distance[open_] = best, other, d1
        upper[open_] = np.sqrt(d1.astype(float)) * (1 + _SLACK)
        lower[open_] = np.sqrt(d2.astype(float)) * (1 - _SLACK)
    if exact:
        rest = np.flatnonzero(distance < 0)
        distance[rest] = _squares(x[rest] - points[first[rest]])
    return first, second, upper, lower, distance


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _assign(vectors: DataFrame, centroids: Centroids, dims: int, wide: bool, exact: bool) -> DataFrame:
    """Vectors with their nearest centroid; those without a state yet are all searched."""
    started = "first" in vectors.columns
    kept = StructType([f for f in vectors.schema.fields if f.name in ("vec_id", "x")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            n = block.num_rows
            if not n:
                continue
            lists = block.column("x").chunk(0)
            x = lists.flatten().to_numpy().reshape(n, dims).astype(object if wide else np.int64)
            if started:
                state = [block.column(c).to_numpy().copy() for c in ("first", "second", "upper", "lower")]
            else:
                state = [np.zeros(n, np.int32), np.full(n, min(1, centroids.k - 1), np.int32), np.full(n, np.inf), np.zeros(n)]
            first, second, upper, lower, distance = search(x, centroids, *state, exact)
            if wide:
                distance = np.array([min(int(d), LARGEST) for d in distance], np.int64)
            yield from pa.table({"vec_id": block.column("vec_id"), "x": block.column("x"), "first": pa.array(first, pa.int32()),
                                 "second": pa.array(second, pa.int32()), "upper": upper, "lower": lower,
                                 "distance": pa.array(distance, pa.int64())}).to_batches()

    return vectors.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in kept)}, {_STATE}")


def _floor_means(assigned: DataFrame, points: np.ndarray, wide: bool) -> np.ndarray:
    """Componentwise floor of the mean of each cluster; an empty one keeps its centroid. At most k rows are collected."""
    kind = "decimal(38,0)" if wide else "long"
    sums = assigned.groupBy("first").agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i].cast(kind)).alias(f"s{i}") for i in range(points.shape[1])])
    moved = points.copy()
    for row in sums.collect():
        moved[row[0]] = [int(s) // row[1] for s in row[2:]]
    return moved


def shallot_clusters(vectors: DataFrame, order: Column, k: int = 40, rounds: int = 5, dims: int = 64) -> tuple[DataFrame, Centroids | None, str]:
    """(vec_id, x, cluster int, distance long) of each vector (vec_id, x array<long> of `dims` components), the final centroids, and the
    path of the table behind them.

    Centroids start as the k vectors that come first in `order` (fewer, if there are fewer); a null order comes last and never starts one.
    Each round assigns every vector to its nearest centroid, ties to the smaller number, and moves each centroid to the floor of its
    vectors' mean; at last all are assigned once more. Repeated rows count as often as they stand. Distances beyond the long
    range are compared exactly and given as its largest value. Without any centroid the result has no rows and the centroids are None.
    The state of a round is a written table, so a lost executor costs no more than the round.
    """
    current, path = write_table(vectors.select("vec_id", "x", order.alias("starts")), "vectors")
    size = current.agg(F.count("*").alias("n"), F.max(F.greatest(F.array_max("x"), -F.array_min("x"))).alias("most")).first()
    seeds = current.where("starts is not null").orderBy("starts", "x").limit(k).select("x").collect()
    if not seeds:
        return current.limit(0).selectExpr("vec_id", "x", "0 as cluster", "0L as distance"), None, path
    # Exact in 64 bits, or in unbounded integers: the results are the same.
    wide = size.most >= SMALL or dims * (2 * size.most) ** 2 >= 1 << 62 or size.most * size.n >= 1 << 62
    centroids = Centroids(np.array([row.x for row in seeds], dtype=object if wide else np.int64))
    current = current.select("vec_id", "x")
    for number in range(rounds + 1):
        done, new_path = write_table(_assign(current, centroids, dims, wide, exact=number == rounds), "clusters")
        drop_table(vectors.sparkSession, path)
        current, path = done, new_path
        if number < rounds:
            centroids = Centroids(_floor_means(current, centroids.points, wide), centroids)
    return current.select("vec_id", "x", F.col("first").alias("cluster"), "distance"), centroids, path


def whole_vectors(vectors: DataFrame, dims: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, x) of the vectors of exactly `dims` components, none null or non-finite: the floor of `scale` times each component.

    Results beyond 2^62 in size are taken as 2^62.
    """
    parts = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists(parts, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    edge = float(1 << 62)
    return vectors.where((F.size("embedding") == dims) & ~bad).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(parts, lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(edge)), F.lit(-edge))).cast("long")).alias("x"))


def cluster_query(vectors: DataFrame) -> DataFrame:
    """The contract of op13. A vector without vec_id is assigned, but starts no centroid."""
    order = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    assigned, centroids, _ = shallot_clusters(whole_vectors(vectors), order)
    # One row for each cluster; sums beyond the long range are given as its largest value.
    sums = {r[0]: r[1] for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)"))).collect()}
    rows = [(c, min(int(s), LARGEST), min(int(sum(sums.values())), LARGEST), centroids.digest(c)) for c, s in sums.items()]
    table = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """The same in SQL, a pair of tables for each round."""
    parts = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""", f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x FROM v WHERE vec_id IS NOT NULL QUALIFY c < {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT v.r, c.c, list_sum([(v.x[i] - c.x[i]) * (v.x[i] - c.x[i]) FOR i IN range(1, {dims + 1})]) AS d FROM v, c{i} c
  QUALIFY row_number() OVER (PARTITION BY v.r ORDER BY d, c.c) = 1)""")
        if i < rounds:
            parts.append(f"""s{i} AS (
  SELECT a.c, unnest(v.x) AS e, generate_subscripts(v.x, 1) AS p FROM a{i} a JOIN v ON v.r = a.r),
m{i} AS (SELECT c, p, (sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS e FROM s{i} GROUP BY c, p),
c{i + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT c, list(CAST(e AS BIGINT) ORDER BY p) AS x FROM m{i} GROUP BY c) n ON n.c = c.c)""")
    return f"""WITH {', '.join(parts)}
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v ON v.r = a.r JOIN c{rounds} c ON c.c = a.c
"""
