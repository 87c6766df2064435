"""Anomaly detectors.

Statistical: entities whose volume and rating disagree (many reviews but a low
rating, or almost none and a perfect one).  Semantic: reviews whose text score
disagrees with their stars.  Both are single filters over one scan; both classes
are kept, tagged, in one result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.functions.columns import NEG_STAR_POS_TEXT, POS_STAR_NEG_TEXT

# Class names of statistical anomalies.
SUSPICIOUS_BAD = "suspicious_bad"
SUSPICIOUS_GOOD = "suspicious_good"


def _classes(count: str, rating: str, bad_min_count: float, bad_max_rating: float,
             good_max_count: float, good_rating: float):
    bad = (F.col(count) > F.lit(bad_min_count)) & (F.col(rating) < F.lit(bad_max_rating))
    good = (F.col(count) < F.lit(good_max_count)) & (F.col(rating) == F.lit(good_rating))
    return bad, good


def statistical_anomalies(df: DataFrame, count: str = "review_count", rating: str = "stars",
                          bad_min_count: float = 500, bad_max_rating: float = 2.0,
                          good_max_count: float = 5, good_rating: float = 5.0) -> DataFrame:
    """``count > bad_min_count and rating < bad_max_rating`` -> suspicious_bad;
    ``count < good_max_count and rating == good_rating`` -> suspicious_good."""
    bad, good = _classes(count, rating, bad_min_count, bad_max_rating, good_max_count, good_rating)
    return (df.filter(bad | good)
            .withColumn("anomaly_class", F.when(bad, F.lit(SUSPICIOUS_BAD)).otherwise(F.lit(SUSPICIOUS_GOOD))))


def anomaly_counts(df: DataFrame, count: str = "review_count", rating: str = "stars",
                   bad_min_count: float = 500, bad_max_rating: float = 2.0,
                   good_max_count: float = 5, good_rating: float = 5.0) -> DataFrame:
    """Both class sizes in one pass; zero when a class is empty."""
    bad, good = _classes(count, rating, bad_min_count, bad_max_rating, good_max_count, good_rating)
    return df.agg(F.count(F.when(bad, 1)).alias("suspicious_bad"),
                  F.count(F.when(good, 1)).alias("suspicious_good"))


def semantic_anomalies(scored: DataFrame, stars: str = "stars", score: str = "sentiment_score",
                       high: float = 5, low: float = 1, neg_below: float = 0.2,
                       pos_above: float = 0.8) -> DataFrame:
    """High stars with a negative text score, or low stars with a positive one."""
    pos_neg = (F.col(stars) == F.lit(high)) & (F.col(score) < F.lit(neg_below))
    neg_pos = (F.col(stars) == F.lit(low)) & (F.col(score) > F.lit(pos_above))
    return (scored.filter(pos_neg | neg_pos)
            .withColumn("anomaly_type",
                        F.when(pos_neg, F.lit(POS_STAR_NEG_TEXT)).otherwise(F.lit(NEG_STAR_POS_TEXT))))
