"""Unions and differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def concat_tables(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def union_ids(*tables: DataFrame) -> DataFrame:
    """Distinct rows of all tables. Each table is made distinct on the way, map side."""
    return reduce(lambda a, b: a.union(b), tables).distinct()


def difference_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of the left table, repeats kept, that are not in the right one."""
    keys = left.columns
    return left.join(right.select(*keys), keys, "left_anti")
