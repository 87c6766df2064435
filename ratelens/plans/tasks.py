"""The named analytics tasks, written against the review data set's schemas.

Each task is a pure ``DataFrame -> DataFrame`` plan; the caller picks the
action (preview CSV, full write, ``show``).  Column names are parameters with
the data set's names as defaults, so the same plan runs on any table shaped
alike (the driver tables bind them in ``plans.standins``).  Output columns carry
the names of the recorded result files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.functions.columns import (
    clean_repr,
    contains_flag,
    friend_count,
    is_present,
    month_of,
)
from ratelens.operators import aggregate as agg
from ratelens.operators.topk import asc, desc, ordered, top_k
from ratelens.schemas import USER, add_missing_columns


# -- Q1 -----------------------------------------------------------------------
def top_categories(business: DataFrame, k: int = 20, categories: str = "categories",
                   sep: str = ", ") -> DataFrame:
    """Most frequent categories: ``category, count`` (top k, ties by name)."""
    counts = agg.token_counts(business, categories, sep=sep, out="category")
    return top_k(counts, k, [desc("count"), asc("category")])


# -- Q2 -----------------------------------------------------------------------
def geo_distribution(business: DataFrame, state: str = "state", city: str = "city",
                     stars: str = "stars", business_id: str = "business_id") -> DataFrame:
    """Mean rating and business count per (state, city); null keys dropped."""
    df = business.filter(F.col(city).isNotNull() & F.col(state).isNotNull())
    df = df.select(F.col(state).alias("state"), F.col(city).alias("city"),
                   F.col(stars).alias("_stars"), F.col(business_id).alias("_id"))
    out = agg.mean_and_count(df, ["state", "city"], "_stars", "average_stars", "business_count", count_col="_id")
    return ordered(out, ["state", "city"])


# -- Q3 -----------------------------------------------------------------------
def open_share_by_city(business: DataFrame, city: str = "city", is_open: str = "is_open",
                       business_id: str = "business_id") -> DataFrame:
    """``city, open_count, total_count, open_percentage`` by total desc."""
    df = business.filter(F.col(city).isNotNull())
    out = agg.open_share(df, city, is_open, business_id, key_name="city")
    return ordered(out, [desc("total_count"), asc("city")])


# -- Q4 -----------------------------------------------------------------------
def price_mix(business: DataFrame, categories: str = "categories", category: str = "Restaurants",
              price: str = "attributes.RestaurantsPriceRange2") -> DataFrame:
    """Price-range counts among businesses whose categories contain ``category``
    (substring, as recorded); null and ``None`` prices dropped."""
    df = (business.filter(F.col(categories).contains(category))
          .select(F.col(price).alias("price_range"))
          .filter(is_present("price_range")))
    return ordered(agg.frequency(df, "price_range"), ["price_range"])


def price_mix_exact(business: DataFrame, categories: str = "categories", category: str = "Restaurants",
                    price: str = "attributes.RestaurantsPriceRange2", sep: str = ", ") -> DataFrame:
    """As ``price_mix`` but with exact category membership."""
    df = (business.filter(F.array_contains(F.split(F.col(categories), sep), category))
          .select(F.col(price).alias("price_range"))
          .filter(is_present("price_range")))
    return ordered(agg.frequency(df, "price_range"), ["price_range"])


# -- Q5 -----------------------------------------------------------------------
def monthly_activity(review: DataFrame, date: str = "date") -> DataFrame:
    """Reviews per ``yyyy-MM``; unparseable dates form the null month."""
    parse = dict(review.dtypes).get(date, "string") == "string"
    df = review.select(month_of(date, parse=parse).alias("year_month"))
    return ordered(agg.frequency(df, "year_month"), ["year_month"])


# -- Q6 -----------------------------------------------------------------------
def top_users(user: DataFrame, k: int = 100, name: str = "name", review_count: str = "review_count",
              user_id: str = "user_id") -> DataFrame:
    """Top k users by review count (ties by id); rows that carry a business id
    are not users and are dropped."""
    df = add_missing_columns(user, USER).filter(F.col("business_id").isNull())
    df = df.select(F.col(name).alias("name"), F.col(review_count).alias("review_count"),
                   F.col(user_id).alias("user_id"))
    return top_k(df, k, [desc("review_count"), asc("user_id")])


# -- Q8 -----------------------------------------------------------------------
def wifi_rating(business: DataFrame, wifi: str = "attributes.WiFi", stars: str = "stars") -> DataFrame:
    """Mean rating per cleaned WiFi value: ``wifi_cleaned, avg_rating, count``."""
    df = (business.select(F.col(stars).alias("_stars"), clean_repr(wifi).alias("wifi_cleaned"))
          .filter(is_present("wifi_cleaned")))
    out = agg.mean_and_count(df, ["wifi_cleaned"], "_stars", "avg_rating", "count")
    return ordered(out, [desc("avg_rating"), asc("wifi_cleaned")])


def parking_rating(business: DataFrame, parking: str = "attributes.BusinessParking",
                   stars: str = "stars", needle: str = "'lot': True") -> DataFrame:
    """Mean rating with/without a parking lot: ``has_lot_parking, avg_rating, count``."""
    df = (business.filter(F.col(parking).isNotNull())
          .select(F.col(stars).alias("_stars"), contains_flag(parking, needle).alias("has_lot_parking")))
    out = agg.mean_and_count(df, ["has_lot_parking"], "_stars", "avg_rating", "count")
    return ordered(out, [desc("avg_rating"), asc("has_lot_parking")])


# -- Q9 -----------------------------------------------------------------------
def with_length(review: DataFrame, text: str = "text") -> DataFrame:
    return review.filter(F.col(text).isNotNull()).withColumn("review_length", F.length(text))


def length_vs_stars(review: DataFrame, text: str = "text", stars: str = "stars",
                    review_id: str = "review_id") -> DataFrame:
    """``stars, avg_length, review_count`` (characters, not bytes)."""
    df = with_length(review, text).select(F.col(stars).alias("stars"), "review_length",
                                          F.col(review_id).alias("_id"))
    out = agg.mean_and_count(df, ["stars"], "review_length", "avg_length", "review_count", count_col="_id")
    return ordered(out, ["stars"])


def length_correlation(review: DataFrame, text: str = "text", stars: str = "stars",
                       digits: int = 4) -> DataFrame:
    """Pearson r of stars and text length with a low-correlation verdict."""
    return agg.correlation(with_length(review, text), stars, "review_length", digits=digits)


# -- Q10 (features) -----------------------------------------------------------
def fans_features(user: DataFrame, review_count: str = "review_count", average_stars: str = "average_stars",
                  fans: str = "fans", friends: str = "friends", max_reviews: float = 500,
                  max_fans: float = 200, legacy_friend_count: bool = False,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """Feature table of the fans regression: doubles, friend count, outliers
    clamped, incomplete rows dropped (``keep`` carries e.g. the user key)."""
    df = user.select(
        *keep,
        F.col(review_count).cast("double").alias("review_count"),
        F.col(average_stars).cast("double").alias("average_stars"),
        F.col(fans).cast("double").alias("label"),
        friend_count(friends, legacy=legacy_friend_count).alias("friend_count"),
    ).filter((F.col("review_count") > 0) & (F.col("review_count") <= F.lit(max_reviews))
             & F.col("average_stars").isNotNull() & (F.col("label") <= F.lit(max_fans)))
    return df.dropna()


# -- Q7 (input rule) ------------------------------------------------------------
def sentiment_input(review: DataFrame, text: str = "text", stars: str = "stars", neutral: int = 3) -> DataFrame:
    """Rows a sentiment model trains on / scores: text present, stars present
    and not neutral; label = stars above neutral."""
    from ratelens.functions.columns import binary_label
    return (review.filter(F.col(text).isNotNull() & F.col(stars).isNotNull() & (F.col(stars) != F.lit(neutral)))
            .withColumn("true_sentiment", binary_label(stars, neutral)))


def label_balance(review: DataFrame, stars: str = "stars", **kw) -> DataFrame:
    """Rows per (stars, sentiment label) after the input rule."""
    return (sentiment_input(review, stars=stars, **kw)
            .groupBy(F.col(stars).alias("true_stars"), "true_sentiment").agg(F.count(F.lit(1)).alias("count")))
