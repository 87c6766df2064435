"""Ordering and top-k.

``top_k`` keeps the limit inside the plan, so Spark runs a
``TakeOrderedAndProject``: each task keeps its own k best rows and only
k x tasks rows meet in the final merge.  Every ordering ends with the key
columns as tie-breakers so results are deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def desc(col: str) -> Column:
    return F.col(col).desc_nulls_last()


def asc(col: str) -> Column:
    return F.col(col).asc_nulls_first()


def ordered(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    return df.orderBy(*[asc(c) if isinstance(c, str) else c for c in order])


def top_k(df: DataFrame, k: int, order: Sequence[Column | str]) -> DataFrame:
    return ordered(df, order).limit(k)


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                    rank_name: str = "rank") -> DataFrame:
    """k best rows per group.

    Use on pre-aggregated input (one row per group x item), where a group holds
    at most as many rows as there are distinct items, never on raw rows.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(w)).filter(F.col(rank_name) <= k)
