"""Summaries of the whole fleet or of each connection alone.

The operators of ``clients``, ``logs`` and ``latency`` take ``keys``: without any they cover all rows
given to them, with ``("connection_id",)`` each connection gets the result of its own rows. Rows without
a key belong to no connection and are counted by the fleet form only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scoped(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows that belong to some key."""
    return df.dropna(subset=list(keys)) if keys else df


def with_totals(df: DataFrame, keys: Sequence[str], **totals: Column) -> DataFrame:
    """df with aggregates over all its rows of the same keys, one row per key joined back.

    The totals are combined before their shuffle. How they travel is the planner's choice by their size at
    run time; a key with a mass of rows is then split by the skew join.
    """
    aggregates = [column.alias(name) for name, column in totals.items()]
    if keys:
        return df.join(df.groupBy(*keys).agg(*aggregates), list(keys))
    whole = df.agg(F.struct(*aggregates)).scalar()
    return df.withColumn("_whole", whole).select(*df.columns, "_whole.*")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows in order, of each key or of all."""
    if not keys:
        return df.orderBy(*order).limit(k)
    # a bounded row_number keeps k rows per key and partition before the shuffle
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")
