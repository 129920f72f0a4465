"""Rows from arrays, columns that are worked out once, and groups of rows in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, array: Column | str, to: str, *keep: str) -> DataFrame:
    """Elements of an array as rows, next to the kept columns (all if none is named).

    From a plain explode the planner infers a filter for non-empty arrays and pushes it below the
    projection that makes the array, which then runs twice. The outer form does without.
    """
    kept = [F.col(c) for c in keep] if keep else [F.col("*")]
    return df.select(*kept, F.explode_outer(array).alias(to)).where(F.col(to).isNotNull())


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once per row, whatever filters follow.

    The planner pushes a filter on a computed column below its projection and so evaluates the
    expression twice. It cannot do so through the generator used here, which yields one row per row.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(F.struct(*[e.alias(n) for n, e in columns.items()]))))


def block_pairs(df: DataFrame, keys: Sequence[str], row: Sequence[str], size: Column | float) -> DataFrame:
    """The rows of each key cut into blocks of about `size`, dealt to every pair (i, j) of its blocks, i <= j.

    `own` is a row's block. Blocks are chosen by a hash of the columns `row`, so a key with many rows is many tasks.
    """
    counts = df.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias("_blocks"))
    dealt = df.join(counts, list(keys)).withColumn("own", F.pmod(F.xxhash64(*row), F.col("_blocks")).cast("int"))
    paired = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return paired.withColumn("i", F.least("own", "_other")).withColumn("j", F.greatest("own", "_other")).drop("_other", "_blocks")


def map_groups(df: DataFrame, keys: Sequence[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What `run` makes of the rows of each key, all of which have to fit a task; for many small groups lighter than a call for each.

    Keys must not be null.
    """
    names = list(keys)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if rest is None else pd.concat((rest, batch), ignore_index=True)
            if not len(rows):
                continue
            changed = (rows[names].shift() != rows[names]).any(axis=1).to_numpy()
            edges = np.flatnonzero(changed)[1:]
            if len(edges):
                yield pd.concat([run(rows.iloc[a:b]) for a, b in zip((0, *edges[:-1]), edges)], ignore_index=True)
                rows = rows.iloc[edges[-1]:]
            rest = rows
        if rest is not None and len(rest):
            yield run(rest)

    return df.repartition(*names).sortWithinPartitions(*names).mapInPandas(stream, schema)
