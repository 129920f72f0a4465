"""First-in-group, flags, ranks, running totals and streaks, none of which needs a whole hot group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrascope.session import cut_lineage


def _columns(names: Sequence[str] | str) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def _digested(df: DataFrame, keys: list[str], by_digest: bool) -> list[Column]:
    """Grouping keys; long texts may stand as their SHA-256, which is shorter to move and to compare."""
    kinds = dict(df.dtypes)
    return [F.unhex(F.sha2(F.col(k), 256)) if by_digest and kinds[k] == "string" else F.col(k) for k in keys]


def first_k(df: DataFrame, keys: Sequence[str] | str, order: Sequence[Column | str], k: int = 1,
            rank: str | None = None, by_digest: bool = False) -> DataFrame:
    """The first k rows of each group, with their rank if a name is given.

    The planner applies the limit within each input partition before the shuffle, so a group that
    holds a third of all rows sends k rows per task. Set `by_digest` for keys that are whole texts.
    """
    name = rank or "_rank"
    window = Window.partitionBy(*_digested(df, _columns(keys), by_digest)).orderBy(*order)
    kept = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def keep_first(df: DataFrame, keys: Sequence[str] | str, order: Sequence[Column | str], by_digest: bool = False) -> DataFrame:
    """First row per key in the given order."""
    return first_k(df, keys, order, 1, by_digest=by_digest)


def flag_duplicates(df: DataFrame, keys: Sequence[str] | str, order: Sequence[str] | str,
                    to: str = "is_duplicate", by_digest: bool = False) -> DataFrame:
    """Whether a row is not the first of its key; False for all rows if a key column is missing.

    The order columns must tell rows apart. The first of each key is found by a map-side combined
    aggregate and joined back on the order columns, which are spread evenly even if a key is not.
    """
    keys, order = _columns(keys), _columns(order)
    if not set(keys) <= set(df.columns):
        return df.withColumn(to, F.lit(False))
    groups = df.groupBy(*[k.alias(f"_key{i}") for i, k in enumerate(_digested(df, keys, by_digest))])
    if len(order) == 1:
        firsts = groups.agg(F.min(order[0]).alias(order[0])).select(order[0])
    else:
        firsts = groups.agg(F.min(F.struct(*order)).alias("_first")).select("_first.*")
    firsts = firsts.withColumn("_is_first", F.lit(True))
    return df.join(firsts, order, "left").withColumn(to, F.col("_is_first").isNull()).drop("_is_first")


def share_within_group(counts: DataFrame, group: Sequence[str] | str, n: str = "n", to: str = "share") -> DataFrame:
    """n over the sum of n in its group; for tables that are already counts."""
    window = Window.partitionBy(*_columns(group))
    return counts.withColumn(to, F.col(n) / F.sum(n).over(window))


def in_ranges(df: DataFrame, order: Sequence[str] | str, piece: str = "_piece") -> DataFrame:
    """The rows with the number of the range of the order that they lie in, as a written table; ranges follow each other.

    The planner cuts the ranges by a sample, as for a sort. Rows that are equal in the order are told apart by a hash of all their
    columns, so that many of them spread over several ranges too.
    """
    order = _columns(order)
    ranged = df.repartitionByRange(*[F.col(c) for c in order], F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    return cut_lineage(ranged.withColumn(piece, F.spark_partition_id()))


def running_totals(df: DataFrame, order: Sequence[str] | str, values: Sequence[str], prefix: str = "running_") -> DataFrame:
    """Cumulative sums along the order.

    The rows are dealt to ranges of the order; sums run within a range, and one row of totals for each range carries on what stands
    before it. No task holds more than a range, or one row for each of them.
    """
    order = _columns(order)
    placed = in_ranges(df, order)
    within = Window.partitionBy("_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    result = placed.select("*", *[F.sum(v).over(within).alias(prefix + v) for v in values])
    totals = placed.groupBy("_piece").agg(*[F.sum(v).alias(v) for v in values])
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("_piece", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_before_{v}") for v in values])
    # As many rows as there are ranges.
    result = result.join(F.broadcast(carry), "_piece")
    for v in values:
        result = result.withColumn(prefix + v, F.col(prefix + v) + F.col(f"_before_{v}")).drop(f"_before_{v}")
    return result.drop("_piece")


def renumber_by_size(sizes: DataFrame, cluster: str = "cluster", size: str = "n", tie: str = "min_id",
                     to: str = "topic", noise: int = -1) -> DataFrame:
    """Clusters numbered from 0, largest first, ties by the id, which may be a text; noise keeps -1."""
    real = sizes.where(F.col(cluster) != noise).withColumn("_one", F.lit(1).cast("long")).withColumn("_descending", -F.col(size))
    numbered = running_totals(real, ["_descending", tie], ["_one"], prefix="_n")
    numbered = numbered.withColumn(to, (F.col("_n_one") - 1).cast("int")).drop("_n_one", "_one", "_descending")
    return numbered.unionByName(sizes.where(F.col(cluster) == noise).withColumn(to, F.lit(noise)))


def _streak_parts(df: DataFrame, worker: str, order: Sequence[str], failed: Column, piece: Column,
                  opening: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(events with their streak within a part, parts with the streak before and after them)."""
    # As structs the keys are never null and match field by field, so rows without worker or time stay.
    df = df.select("*", F.struct(worker).alias("_who"), F.struct(piece).alias("_piece"),
                   F.coalesce(failed, F.lit(False)).alias("_failed"))
    part = Window.partitionBy("_who", "_piece").orderBy(*order)
    so_far = part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = df.withColumn("_resets", F.sum((~F.col("_failed")).cast("long")).over(so_far))
    island = Window.partitionBy("_who", "_piece", "_resets").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumn("_local", F.sum(F.col("_failed").cast("long")).over(island))

    # One row per part: did it reset, and how many failures stand at its end.
    counts = marked.groupBy("_who", "_piece", "_resets").agg(F.max("_local").alias("_open"))
    tails = counts.groupBy("_who", "_piece").agg(F.max("_resets").alias("_total"),
                                                 F.max_by("_open", "_resets").alias("_tail"))
    along = Window.partitionBy("_who").orderBy("_piece")
    up_to = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tails = tails.withColumn("_island", F.sum((F.col("_total") > 0).cast("long")).over(up_to))
    in_island = Window.partitionBy("_who", "_island").orderBy("_piece").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    tails = tails.withColumn("_run", F.sum("_tail").over(in_island))
    opened = F.lit(0).cast("long")
    if opening is not None:
        first = opening.select(F.struct(F.col(worker)).alias("_who"), F.col("open").alias("_opened"))
        tails = tails.join(first, "_who", "left")
        opened = F.coalesce("_opened", opened)
    # An opening streak goes on as long as nothing has reset it.
    carry = F.coalesce(F.lag("_run").over(along), F.lit(0)) + F.when(F.coalesce(F.lag("_island").over(along), F.lit(0)) == 0, opened).otherwise(0)
    close = F.col("_run") + F.when(F.col("_island") == 0, opened).otherwise(0)
    return marked, tails.select("_who", "_piece", carry.alias("_carry"), close.alias("_close"))


def failure_streak(df: DataFrame, worker: str, order: Sequence[str], failed: Column, piece: Column,
                   limit: int, to: str = "streak", opening: DataFrame | None = None) -> DataFrame:
    """Number of failures in a row up to each event of a worker, and whether it reached the limit.

    `piece` cuts a worker's time line into consecutive parts (an hour, a day). Streaks are counted
    within parts, and one row per part carries the open streak on, so that no task holds more than
    one part of a busy worker. `opening` (worker, open) gives streaks left open before these events.
    """
    marked, parts = _streak_parts(df, worker, order, failed, piece, opening)
    joined = marked.join(parts.drop("_close"), ["_who", "_piece"])
    streak = F.col("_local") + F.when(F.col("_resets") == 0, F.col("_carry")).otherwise(0)
    return (joined.withColumn(to, streak).withColumn("tripped", F.col(to) >= limit)
            .drop("_who", "_piece", "_failed", "_resets", "_local", "_carry"))


def open_streaks(df: DataFrame, worker: str, order: Sequence[str], failed: Column, piece: Column,
                 opening: DataFrame | None = None) -> DataFrame:
    """(worker, open): the streak each worker ends with, workers without new events included."""
    _, parts = _streak_parts(df, worker, order, failed, piece, opening)
    ends = parts.groupBy("_who").agg(F.max_by("_close", "_piece").alias("open")).select(F.col(f"_who.{worker}").alias(worker), "open")
    if opening is None:
        return ends
    seen = ends.select(F.struct(worker).alias("_who"))
    rest = opening.withColumn("_who", F.struct(worker)).join(seen, "_who", "left_anti").drop("_who")
    return ends.unionByName(rest.select(worker, "open"))
