"""Pairs of vectors of high cosine, each given once.

Equal vectors stand as one representative, so a vector in many copies makes no pairs with itself. Tables of random projections
(Charikar 2002) find most pairs: the signs along random directions name a bucket in each table, and two vectors whose angle is
small share a bucket in one of them. A pair that meets in several tables is given by the first. The exact mode needs no luck:
along any direction two vectors of cosine c are at most sqrt(2 - 2c) apart, so pairs lie in the same or touching cells of a grid
over a few principal directions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrascope.operators.rows import block_pairs, map_groups
from narrascope.session import cut_lineage

#: Vectors of a block and components of all its vectors; what has more is compared block by block.
BLOCK, NUMBERS = 1 << 15, 1 << 21
#: Vectors of a block that are compared with another block at a time.
STRIP = 256
#: Vectors that a bucket of random projections holds by default.
BUCKET = 512
#: Directions of the grid of the exact mode.
AXES = 3


def representatives(df: DataFrame, vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """(id, rep): for each vector the least id among its equals. Null, empty and zero vectors and those with null or non-finite components
    take no part."""
    usable = _usable(df, vector, id_column)
    return usable.join(usable.groupBy("x").agg(F.min("id").alias("rep")), "x").select("id", "rep")


def _usable(df: DataFrame, vector: str, id_column: str) -> DataFrame:
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.when(~bad, x).alias("x"))
    return rows.where(F.exists("x", lambda v: v != 0))


def _units(df: DataFrame, vector: str, id_column: str) -> DataFrame:
    """(id, u): each distinct vector at unit length, with the least id."""
    distinct = _usable(df, vector, id_column).groupBy("x").agg(F.min("id").alias("id"))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    return cut_lineage(distinct.select("id", F.size("x").alias("dims"), length.alias("length"), "x").select(
        "id", "dims", F.transform("x", lambda v: v / F.col("length")).alias("u")))


def share_of_tables(least: float, bits: int) -> float:
    """Probability that two vectors of that cosine fall in one bucket of a table."""
    return (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** bits


def tables_for(least: float, bits: int, recall: float) -> int:
    """Tables needed to find a pair of the least cosine with a probability of at least `recall`."""
    share = share_of_tables(least, bits)
    return 1 if share >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - share)))


def _signs(units: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """Add `keys`: the bucket in each table, and `marks`, the same as bytes. The random directions follow from the seed and the vectors' length."""
    kind = _mark(bits)

    def run(batches):
        directions: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = np.empty((len(batch), tables), np.int64)
            for dims, rows in batch.groupby("dims").indices.items():
                if dims not in directions:
                    directions[dims] = np.random.default_rng([seed, int(dims)]).normal(size=(int(dims), tables * bits))
                ahead = np.stack(batch["u"].iloc[rows].to_list()) @ directions[dims] > 0
                keys[rows] = ahead.reshape(len(rows), tables, bits) @ (1 << np.arange(bits))
            yield batch.assign(keys=list(keys), marks=[k.tobytes() for k in keys.astype(kind)])

    return units.mapInPandas(run, "id long, dims int, u array<double>, keys array<long>, marks binary")


def _mark(bits: int) -> type:
    return np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.int64


def _close(left: np.ndarray, right: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in left, places in right, cosines) of the pairs of at least that cosine, strip by strip; within the same block each pair once."""
    for at in range(0, len(left), STRIP):
        first = at if same else 0
        cosines = left[at:at + STRIP] @ right[first:].T
        p, q = np.nonzero(cosines >= least)
        if same:
            p, q = p[p < q], q[p < q]
        yield p + at, q + first, cosines[p, q]


def _as_pairs(a: np.ndarray, b: np.ndarray, cosines: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "cosine": np.clip(cosines, -1, 1)})


_NO_PAIRS = pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "cosine": np.empty(0)})


def near_pairs(df: DataFrame, least: float, vector: str = "embedding", id_column: str = "vec_id", recall: float = 0.95,
               bits: int | None = None, seed: int = 0) -> DataFrame:
    """(a, b, cosine), a < b: pairs of distinct vectors of the same length whose cosine is at least `least`, each once.

    A pair is found with a probability of at least `recall` (more, the closer it is); ids are whole numbers. With `bits` signs a bucket holds
    about 2 ** -bits of unrelated vectors; by default that is about a block. `representatives` tells which ids share a vector.
    """
    units = _units(df, vector, id_column)
    bits = bits or max(4, math.ceil(math.log2(max(1, units.count() / BUCKET))))
    tables, kind = tables_for(least, bits, recall), _mark(bits)
    # Written once for each vector; the copies for the tables are made where they are dealt.
    placed = cut_lineage(_signs(units, tables, bits, seed).withColumn("id", F.col("id").cast("long")))
    rows = placed.select("dims", F.posexplode("keys").alias("table", "key"), "id", "u", "marks")
    size = F.greatest(F.lit(1.0), F.least(F.lit(float(BLOCK)), F.lit(float(NUMBERS)) / F.col("dims")))
    dealt = block_pairs(rows, ["dims", "table", "key"], ["id"], size)

    def run(block: pd.DataFrame) -> pd.DataFrame:
        i, j, table = block["i"].iloc[0], block["j"].iloc[0], int(block["table"].iloc[0])
        left, right = block[block["own"] == i], block[block["own"] == j]
        if not len(left) or not len(right):
            return _NO_PAIRS
        marks = [np.frombuffer(b"".join(side["marks"]), kind).reshape(len(side), tables)[:, :table] for side in (left, right)]
        ids = [side["id"].to_numpy() for side in (left, right)]
        found = [_NO_PAIRS]
        for p, q, cosines in _close(np.stack(left["u"].to_list()), np.stack(right["u"].to_list()), least, i == j):
            # Given by the first table in which the two share a bucket.
            first = ~(marks[0][p] == marks[1][q]).any(axis=1)
            found.append(_as_pairs(ids[0][p[first]], ids[1][q[first]], cosines[first]))
        return pd.concat(found, ignore_index=True)

    return map_groups(dealt, ["dims", "table", "key", "i", "j"], run, "a long, b long, cosine double")


def _axes(units: DataFrame) -> DataFrame:
    """(dims, axes): AXES orthonormal principal directions for each length of vectors, from one matrix of products for each; zeros where a vector
    has fewer components."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        products = np.array(rows["products"].iloc[0]).reshape(int(rows["dims"].iloc[0]), -1)
        found = np.zeros((AXES, len(products)))
        found[:len(products)] = np.linalg.eigh(products)[1][:, ::-1][:, :AXES].T
        return pd.DataFrame({"dims": rows["dims"], "axes": [[list(map(float, a)) for a in found]]})

    def products(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dims, rows in batch.groupby("dims").indices.items():
                u = np.stack(batch["u"].iloc[rows].to_list())
                sums[dims] = sums.get(dims, 0) + u.T @ u
        if sums:
            yield pd.DataFrame({"dims": list(map(int, sums)), "v": [m.ravel().tolist() for m in sums.values()]})

    parts = units.select("dims", "u").mapInPandas(products, "dims int, v array<double>")
    summed = parts.select("dims", array_to_vector("v").alias("v")).groupBy("dims").agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("products"))
    return summed.groupBy("dims").applyInPandas(run, "dims int, axes array<array<double>>")


def _packed(placed: DataFrame) -> DataFrame:
    """(block, dims, low, high, ids, us): the vectors in the order of their cells, cut into blocks of one row each; `low` and `high` bound a
    block's cells. Blocks are numbered from 0."""
    size = placed.agg(F.count("*").alias("n"), F.sum(F.col("dims").cast("long")).alias("numbers")).first()
    parts = max(1, math.ceil(size.n / BLOCK), math.ceil((size.numbers or 0) / NUMBERS))
    most, numbers = BLOCK, NUMBERS

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = [batch for batch in batches if len(batch)]
        if waiting:
            for dims, rows in pd.concat(waiting, ignore_index=True).groupby("dims"):
                step = max(1, min(most, numbers // int(dims)))
                for at in range(0, len(rows), step):
                    block = rows.iloc[at:at + step]
                    cells, ids = np.stack(block["cell"].to_list()), block["id"].to_numpy(np.int64)
                    yield pd.DataFrame({"first": [ids.min()], "dims": [dims], "low": [cells.min(axis=0).tolist()], "high": [cells.max(axis=0).tolist()],
                                        "ids": [ids.tobytes()], "us": [np.stack(block["u"].to_list()).astype(float).tobytes()]})

    ordered = placed.repartitionByRange(parts, "dims", "cell", "id").sortWithinPartitions("dims", "cell", "id")
    packed = cut_lineage(ordered.mapInPandas(pack, "first long, dims int, low array<long>, high array<long>, ids binary, us binary"))
    # As many small rows as there are blocks; each vector is in one block, so the least ids differ.
    numbers_of = packed.select("first").withColumn("block", (F.row_number().over(Window.orderBy("first")) - 1).cast("int"))
    return packed.join(F.broadcast(numbers_of), "first").drop("first")


def near_pairs_exact(df: DataFrame, least: float, vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """The same with no pair missed. The lower the cosine, the more cells touch.

    Blocks of vectors in the order of their cells meet if their cells do. A block is written once and read by the tasks that compare it with
    another, so disk grows with the vectors alone.
    """
    units = _units(df, vector, id_column)
    reach = math.sqrt(max(0.0, 2 - 2 * least)) * (1 + 1e-9) + 1e-9
    axes = F.broadcast(cut_lineage(_axes(units)))  # A few directions for each length of vectors.

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    cell = F.transform("axes", lambda a: F.floor(dot(a, F.col("u")) / reach))
    packed = _packed(cut_lineage(units.join(axes, "dims").select("dims", F.col("id").cast("long").alias("id"), "u", cell.alias("cell"))))
    blocks = max(1, packed.select("block").count())
    columns = ["block", "dims", "low", "high", "ids", "us"]
    left = packed.select(*columns).repartitionById(blocks, F.col("block"))
    right = packed.select(*[F.col(c).alias(f"{c}2") for c in columns]).repartitionById(blocks, F.col("block2"))
    touch = [(F.col("low")[k] <= F.col("high2")[k] + 1) & (F.col("low2")[k] <= F.col("high")[k] + 1) for k in range(AXES)]
    met = left.join(right.hint("shuffle_replicate_nl"), reduce(and_, touch, (F.col("block") <= F.col("block2")) & (F.col("dims") == F.col("dims2"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = np.frombuffer(row.ids, np.int64), np.frombuffer(row.ids2, np.int64)
                sides = (np.frombuffer(us).reshape(-1, row.dims) for us in (row.us, row.us2))
                for p, q, cosines in _close(*sides, least, row.block == row.block2):
                    yield _as_pairs(ids[0][p], ids[1][q], cosines)

    return met.select("block", "block2", "dims", "ids", "ids2", "us", "us2").mapInPandas(run, "a long, b long, cosine double")


def pair_recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact pairs that were found."""
    row = exact.join(found.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
    return row.hits / row.n if row.n else 1.0
