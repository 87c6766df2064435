"""Explicit schemas of the review data set and the missing-column rule.

The source collections are schemaless documents; we read them with fixed
``StructType``s so scans never infer and every plan is stable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Attribute names of the business documents (data-set field names).
ATTRIBUTE_NAMES = [
    "AcceptsInsurance", "Alcohol", "Ambience", "BYOB", "BYOBCorkage", "BestNights", "BikeParking",
    "BusinessAcceptsBitcoin", "BusinessAcceptsCreditCards", "BusinessParking", "ByAppointmentOnly",
    "Caters", "CoatCheck", "Corkage", "DietaryRestrictions", "DogsAllowed", "DriveThru",
    "GoodForDancing", "GoodForKids", "GoodForMeal", "HairSpecializesIn", "HappyHour", "HasTV",
    "Music", "NoiseLevel", "OutdoorSeating", "RestaurantsAttire", "RestaurantsCounterService",
    "RestaurantsDelivery", "RestaurantsGoodForGroups", "RestaurantsPriceRange2",
    "RestaurantsReservations", "RestaurantsTableService", "RestaurantsTakeOut", "Smoking",
    "WheelchairAccessible", "WiFi",
]

# Weekday names of the opening-hours struct.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

ATTRIBUTES = T.StructType([T.StructField(n, T.StringType(), True) for n in ATTRIBUTE_NAMES])
HOURS = T.StructType([T.StructField(n, T.StringType(), True) for n in WEEKDAYS])

BUSINESS = T.StructType([
    T.StructField("business_id", T.StringType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("address", T.StringType(), True),
    T.StructField("city", T.StringType(), True),
    T.StructField("state", T.StringType(), True),
    T.StructField("postal_code", T.StringType(), True),
    T.StructField("latitude", T.DoubleType(), True),
    T.StructField("longitude", T.DoubleType(), True),
    T.StructField("stars", T.DoubleType(), True),
    T.StructField("review_count", T.IntegerType(), True),
    T.StructField("is_open", T.IntegerType(), True),
    T.StructField("categories", T.StringType(), True),
    T.StructField("attributes", ATTRIBUTES, True),
    T.StructField("hours", HOURS, True),
])

REVIEW = T.StructType([
    T.StructField("review_id", T.StringType(), True),
    T.StructField("business_id", T.StringType(), True),
    T.StructField("user_id", T.StringType(), True),
    T.StructField("stars", T.IntegerType(), True),
    T.StructField("date", T.StringType(), True),
    T.StructField("text", T.StringType(), True),
])

USER = T.StructType([
    T.StructField("user_id", T.StringType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("review_count", T.IntegerType(), True),
    T.StructField("average_stars", T.DoubleType(), True),
    T.StructField("fans", T.IntegerType(), True),
    T.StructField("friends", T.StringType(), True),
    # stray key seen in some exports; rows carrying it are not users
    T.StructField("business_id", T.StringType(), True),
])

PREDICTIONS = T.StructType([
    T.StructField("text", T.StringType(), True),
    T.StructField("true_stars", T.IntegerType(), True),
    T.StructField("true_sentiment", T.IntegerType(), True),
    T.StructField("predicted_sentiment", T.IntegerType(), True),
    T.StructField("correct", T.BooleanType(), True),
])

SCHEMAS = {"business": BUSINESS, "review": REVIEW, "user": USER, "predictions": PREDICTIONS}


def add_missing_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add every top-level field of ``schema`` absent from ``df`` as a typed null.

    Replaces ``if "x" in df.columns`` branches: after this call a filter such as
    ``business_id IS NULL`` is always valid and the plan shape never depends on
    which export was loaded.
    """
    present = set(df.columns)
    extra = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in present]
    return df.select("*", *extra) if extra else df
