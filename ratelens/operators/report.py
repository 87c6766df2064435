"""Report tables behind the charts, computed from full task results.

(The charts themselves are not drawn; these are the tables a plotting tool
would read.)  Each table is a small plan on top of a task's result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.functions.columns import month_start
from ratelens.operators import aggregate as agg
from ratelens.operators.topk import asc, desc, top_k

# Quantiles of a letter-value summary (eighths and quartiles).
LETTER_VALUE_PROBS = (0.125, 0.25, 0.5, 0.75, 0.875)


def category_share(top_categories: DataFrame, k: int = 15) -> DataFrame:
    """Top-k categories and each one's share of the displayed total."""
    return agg.share_of_total(top_k(top_categories, k, [desc("count"), asc("category")]), "count")


def state_share(geo: DataFrame, k: int = 8) -> DataFrame:
    """Businesses per state rolled up from (state, city), top k with shares."""
    rolled = agg.rollup_sum(geo, "state", "business_count")
    return agg.share_of_total(top_k(rolled, k, [desc("business_count"), asc("state")]), "business_count")


def top_cities(geo: DataFrame, k: int = 15) -> DataFrame:
    """Cities with most businesses, from counts per city or per (state, city)."""
    rolled = agg.rollup_sum(geo, "city", "business_count")
    return top_k(rolled, k, [desc("business_count"), asc("city")])


def open_closed(open_share: DataFrame, k: int = 12) -> DataFrame:
    top = top_k(open_share, k, [desc("total_count"), asc("city")])
    return top.select("city", "open_count", (F.col("total_count") - F.col("open_count")).alias("closed_count"),
                      "total_count", "open_percentage")


def price_share(price_mix: DataFrame) -> DataFrame:
    return agg.share_of_total(price_mix, "count")


def monthly_series(monthly: DataFrame) -> DataFrame:
    return monthly.select("year_month", month_start("year_month").alias("month_start"), "count")


def top_user_quantiles(top_users: DataFrame, probs: Sequence[float] = LETTER_VALUE_PROBS) -> DataFrame:
    return agg.quantiles(top_users, "review_count", probs)


def anomaly_type_counts(anomalies: DataFrame, col: str = "anomaly_class") -> DataFrame:
    return agg.frequency(anomalies, col).orderBy(desc("count"), asc(col))
