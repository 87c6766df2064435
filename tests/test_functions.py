"""Edge rows of FIXTURES.md part C, one test per null / sentinel rule."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ratelens.functions import columns as C
from ratelens.operators import aggregate as agg
from ratelens.operators.anomaly import semantic_anomalies, statistical_anomalies
from ratelens.plans import tasks


def test_categories_explode(spark):
    df = spark.createDataFrame([("a, b",), (None,), ("",), ("None",)], "categories string")
    got = sorted((r.category, r["count"]) for r in agg.token_counts(df, "categories").collect())
    assert got == [("", 1), ("None", 1), ("a", 1), ("b", 1)]


def test_wifi_cleaning(spark):
    rows = [("u'free'", 4.0), ("'free'", 3.0), ("u'no'", 2.0), ("None", 1.0), (None, 1.0), ("paid", 5.0),
            ("u'None'", 1.0)]
    df = spark.createDataFrame([({"WiFi": w}, s) for w, s in rows], "attributes struct<WiFi:string>, stars double")
    got = {r.wifi_cleaned: (r.avg_rating, r["count"]) for r in tasks.wifi_rating(df).collect()}
    assert got == {"free": (3.5, 2), "no": (2.0, 1), "paid": (5.0, 1)}


def test_parking_flag(spark):
    rows = [("{'lot': True, 'valet': False}", 4.0), ("{'lot': False}", 3.0), ("None", 2.0), (None, 1.0)]
    df = spark.createDataFrame([({"BusinessParking": p}, s) for p, s in rows],
                               "attributes struct<BusinessParking:string>, stars double")
    got = {r.has_lot_parking: (r.avg_rating, r["count"]) for r in tasks.parking_rating(df).collect()}
    assert got == {"Yes": (4.0, 1), "No": (2.5, 2)}
    flags = [r.f for r in df.select(C.literal_flag("attributes.BusinessParking", "lot").alias("f")).collect()]
    assert flags == [True, False, False, None]


def test_friend_count(spark):
    df = spark.createDataFrame([("a, b",), (None,), ("None",), ("",), ("x,y,z",)], "friends string")
    got = [r.n for r in df.select(C.friend_count("friends").alias("n")).collect()]
    legacy = [r.n for r in df.select(C.friend_count("friends", legacy=True).alias("n")).collect()]
    assert got == [2, 0, 0, 0, 3]
    assert legacy == [2, None, 1, 1, 3]


def test_month_of_bad_dates(spark):
    df = spark.createDataFrame([("2020-01-31 23:59:59",), ("garbage",), (None,)], "date string")
    got = {r.year_month: r["count"] for r in tasks.monthly_activity(df).collect()}
    assert got == {"2020-01": 1, None: 2}


def test_city_groups_keep_blank_and_case(spark):
    df = spark.createDataFrame([(None, "X", 3.0, "1", 1), ("", "X", 4.0, "2", 1), ("Edmonton", "X", 5.0, "3", 0),
                                ("EdMonton", "X", 2.0, "4", 1)],
                               "city string, state string, stars double, business_id string, is_open int")
    assert tasks.geo_distribution(df).count() == 3
    share = {r.city: r.open_percentage for r in tasks.open_share_by_city(df).collect()}
    assert share == {"": 100.0, "Edmonton": 0.0, "EdMonton": 100.0}


def test_corr_pairwise_complete(spark):
    df = spark.createDataFrame([(1, 10), (2, None), (3, 35), (None, 500), (4, 20)], "a int, b int")
    r = agg.correlation(df, "a", "b").collect()[0]
    assert r.correlation == pytest.approx(0.5636, abs=1e-4)
    assert r.n == 3 and r.verdict == "correlated"


def test_round_half_up(spark):
    df = spark.createDataFrame([(2.675,), (1.005,), (0.125,), (72.365,)], "x double")
    assert [r.y for r in df.select(F.round("x", 2).alias("y")).collect()] == [2.68, 1.01, 0.13, 72.37]


def test_text_length_counts_characters(spark):
    df = spark.createDataFrame([("é😀a ",)], "t string")
    assert df.select(F.length("t").alias("n")).collect()[0].n == 4


def test_null_ordering(spark):
    from ratelens.operators.topk import asc, desc
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert [r.x for r in df.orderBy(asc("x")).collect()] == [None, 1, 3]
    assert [r.x for r in df.orderBy(desc("x")).collect()] == [3, 1, None]


def test_statistical_anomaly_classes(spark):
    df = spark.createDataFrame([(501, 1.9), (500, 1.9), (501, 2.0), (4, 5.0), (5, 5.0)],
                               "review_count int, stars double")
    got = sorted((r.review_count, r.stars, r.anomaly_class) for r in statistical_anomalies(df).collect())
    assert got == [(4, 5.0, "suspicious_good"), (501, 1.9, "suspicious_bad")]


def test_semantic_anomaly_classes(spark):
    df = spark.createDataFrame([(5, 0.19), (5, 0.2), (1, 0.81), (1, 0.8), (3, 0.9)],
                               "stars int, sentiment_score double")
    got = sorted((r.stars, r.sentiment_score, r.anomaly_type) for r in semantic_anomalies(df).collect())
    assert got == [(1, 0.81, C.NEG_STAR_POS_TEXT), (5, 0.19, C.POS_STAR_NEG_TEXT)]


def test_confusion_matrix_zero_fill(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (None, 1)], "t int, p int")
    got = {r.true_label: (r.n_pred_0, r.n_pred_1) for r in agg.confusion_matrix(df, "t", "p").collect()}
    assert got == {1: (1, 1), 0: (1, 0)}


def test_preview_and_labels(spark):
    df = spark.createDataFrame([("x" * 61, 1), ("short", 0)], "t string, s int")
    rows = df.select(C.preview_text("t").alias("p"), C.sentiment_name("s").alias("n")).collect()
    assert rows[0].p == "x" * 60 + "..." and rows[1].p == "short"
    assert [r.n for r in rows] == ["Positive", "Negative"]


def test_binary_label_and_pct(spark):
    df = spark.createDataFrame([(5, 1, 3), (3, 0, 0), (None, 2, 4)], "s int, a int, b int")
    rows = df.select(C.binary_label("s").alias("l"), C.pct("a", "b").alias("p")).collect()
    assert [(r.l, r.p) for r in rows] == [(1, 33.33), (0, None), (None, 50.0)]


def test_price_mix_substring_vs_exact(spark):
    df = spark.createDataFrame([("Restaurants, Bars", {"RestaurantsPriceRange2": "2"}),
                                ("Fast Restaurants Co", {"RestaurantsPriceRange2": "1"}),
                                ("Restaurants", {"RestaurantsPriceRange2": "None"}),
                                (None, {"RestaurantsPriceRange2": "3"})],
                               "categories string, attributes struct<RestaurantsPriceRange2:string>")
    assert {r.price_range: r["count"] for r in tasks.price_mix(df).collect()} == {"1": 1, "2": 1}
    assert {r.price_range: r["count"] for r in tasks.price_mix_exact(df).collect()} == {"2": 1}


def test_top_users_drop_business_rows(spark):
    df = spark.createDataFrame([("u1", "A", 5, None), ("u2", "B", 9, "b1"), ("u3", "C", 5, None)],
                               "user_id string, name string, review_count int, business_id string")
    got = [(r.user_id, r.review_count) for r in tasks.top_users(df, 2).collect()]
    assert got == [("u1", 5), ("u3", 5)]
    no_col = df.drop("business_id")
    assert tasks.top_users(no_col, 1).collect()[0].user_id == "u2"


def test_hot_key_aggregate_is_exact(spark):
    """A category carried by a third of the rows: partial aggregation keeps
    the count exact and the plan has a partial aggregate before the shuffle."""
    rows = [("Restaurants",)] * 3000 + [(f"c{i % 700}, Restaurants" if i % 3 == 0 else f"c{i % 700}",)
                                        for i in range(6000)]
    df = spark.createDataFrame(rows, "categories string").repartition(8)
    counts = agg.token_counts(df, "categories")
    got = {r.category: r["count"] for r in counts.collect()}
    assert got["Restaurants"] == 3000 + 2000
    assert sum(got.values()) == 3000 + 6000 + 2000
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_scale_settings():
    from ratelens.session import scale_settings
    s = scale_settings(100 << 40)
    assert int(s["spark.sql.shuffle.partitions"]) == 200_000
    assert int(scale_settings(1 << 30)["spark.sql.shuffle.partitions"]) == 200
