"""Hot-key splitting for joins against a table with one row per key.

A key that holds a large share of one join side (a hub user, a giant
component's centre) would put that share of the rows into one shuffle
partition.  ``split_join`` routes the rows of hot keys through a broadcast
join with just those keys' rows of the keyed side (no shuffle), and only the
remaining rows through the shuffled join (``apart``: sorted and merged, since both
sides grow with the data; a broadcast would bring one of them through the driver).

A key is hot when its row count exceeds ``max(min_rows, share * total)``, so
fewer than ``1 / share`` keys can be hot: the hot list is bounded by
construction, whatever the data size (and checked when it is fetched).  When
no key is hot the join is the plain shuffled join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class HotKeys:
    # a key is hot above max(min_rows, share * total rows); fewer than 1/share such keys
    share: float = 0.01
    min_rows: int = 1_000_000

    @property
    def max_keys(self) -> int:
        return math.ceil(1 / self.share) if self.share > 0 else 10_000


def hot_keys(counts: DataFrame, key: str, count_col: str, total, policy: HotKeys) -> list:
    """Hot key values of ``counts`` (one row per key, ``count_col`` = rows of
    the key on the skewed side); ``total`` is the skewed side's row count (a
    number or a Column such as a scalar subquery)."""
    total_col = total if not isinstance(total, (int, float)) else F.lit(total)
    threshold = F.greatest(F.lit(float(policy.min_rows)), total_col.cast("double") * F.lit(policy.share))
    rows = counts.filter(F.col(count_col) > threshold).select(key).limit(policy.max_keys + 1).collect()
    if len(rows) > policy.max_keys:
        raise ValueError(f"more than {policy.max_keys} hot keys in {key!r}")
    return [r[0] for r in rows]


def apart(df: DataFrame) -> DataFrame:
    """A join side that grows with the data: it is shuffled to the other side, not
    broadcast, however small its files look (compressed, they say little of its rows)."""
    return df.hint("merge")


def split_join(big: DataFrame, keyed: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """``big`` joined with ``keyed`` (unique on ``key``); hot keys via broadcast.

    ``how`` is ``inner`` or ``left_semi``.  The hot part of ``keyed`` has at
    most one row per hot key, so its broadcast is bounded like ``hot``.
    """
    if not hot:
        return big.join(apart(keyed), key, how)
    is_hot = F.col(key).isin(hot)
    hot_part = big.filter(is_hot).join(F.broadcast(keyed.filter(is_hot)), key, how)
    cold_part = big.filter(~is_hot).join(apart(keyed), key, how)
    return hot_part.unionByName(cold_part)
