"""Turning arrays into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep: list, array: Column | str, item: str, pos: str = "_pos") -> DataFrame:
    """One row per array element, as columns `keep`, `pos` and `item`.

    A plain explode makes the optimizer add a filter on the array's size in front of it, which
    computes the array a second time, and does so below any repartitioning. The outer form has no
    such filter; the rows it adds for empty arrays are dropped behind it.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, item)).where(F.col(pos).isNotNull())


def unnest_map(df: DataFrame, keep: list, entries: Column | str, key: str, value: str) -> DataFrame:
    return df.select(*keep, F.explode_outer(entries).alias(key, value)).where(F.col(key).isNotNull())
