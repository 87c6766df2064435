"""Readers, sinks and the reference-schema tasks end to end."""

from __future__ import annotations

import glob
import json
import os

from pyspark.sql import functions as F

from ratelens import schemas
from ratelens.operators.anomaly import anomaly_counts, statistical_anomalies
from ratelens.plans import tasks
from ratelens.sources import read_result_csv, read_table, save_full, save_preview

BUSINESS_DOCS = [
    {"business_id": "b1", "name": "A", "city": "Edmonton", "state": "AB", "stars": 1.5, "review_count": 600,
     "is_open": 1, "categories": "Restaurants, Bars",
     "attributes": {"WiFi": "u'free'", "BusinessParking": "{'lot': True}", "RestaurantsPriceRange2": "2"}},
    {"business_id": "b2", "name": "B", "city": "Edmonton", "state": "AB", "stars": 4.0, "review_count": 10,
     "is_open": 0, "categories": "Bars", "attributes": {"WiFi": "'no'", "BusinessParking": "{'lot': False}"}},
    {"business_id": "b3", "name": "C", "city": None, "state": "AB", "stars": 5.0, "review_count": 3,
     "is_open": 1, "categories": None, "attributes": {"WiFi": "None"}},
]


def write_json(path, docs):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        for d in docs:
            f.write(json.dumps(d) + "\n")


def test_json_collection_with_schema_and_tasks(spark, tmp_dir):
    write_json(f"{tmp_dir}/business.json/part-0.json", BUSINESS_DOCS)
    b = read_table(spark, tmp_dir, "business", fmt="json")
    assert b.schema == schemas.BUSINESS
    assert {r.category: r["count"] for r in tasks.top_categories(b).collect()} == {"Bars": 2, "Restaurants": 1}
    geo = tasks.geo_distribution(b).collect()
    assert [(r.state, r.city, r.average_stars, r.business_count) for r in geo] == [("AB", "Edmonton", 2.75, 2)]
    assert {r.price_range: r["count"] for r in tasks.price_mix(b).collect()} == {"2": 1}
    assert {r.wifi_cleaned for r in tasks.wifi_rating(b).collect()} == {"free", "no"}
    an = statistical_anomalies(b).collect()
    assert sorted((r.business_id, r.anomaly_class) for r in an) == [("b1", "suspicious_bad"), ("b3", "suspicious_good")]
    counts = anomaly_counts(b).collect()[0]
    assert (counts.suspicious_bad, counts.suspicious_good) == (1, 1)


def test_preview_sink_and_struct_to_json(spark, tmp_dir):
    write_json(f"{tmp_dir}/business.json/part-0.json", BUSINESS_DOCS)
    b = read_table(spark, tmp_dir, "business", fmt="json")
    save_preview(b.orderBy("business_id"), f"{tmp_dir}/preview", n=2)
    files = glob.glob(f"{tmp_dir}/preview/*.csv")
    assert len(files) == 1
    back = read_result_csv(spark, f"{tmp_dir}/preview", columns=["business_id", "attributes"])
    rows = back.collect()
    assert [r.business_id for r in rows] == ["b1", "b2"]
    assert json.loads(rows[0].attributes)["WiFi"] == "u'free'"


def test_full_sink_parquet(spark, tmp_dir):
    df = spark.range(0, 100).withColumn("k", F.col("id") % 3)
    save_full(df, f"{tmp_dir}/full", partition_by=["k"])
    assert spark.read.parquet(f"{tmp_dir}/full").count() == 100


def test_review_and_user_tasks(spark):
    review = spark.createDataFrame(
        [("r1", "b1", "u1", 5, "2020-01-05", "good"), ("r2", "b1", "u2", 1, "2020-01-09", "bad bad"),
         ("r3", "b2", "u1", 5, "bad date", None)], schemas.REVIEW)
    assert {r.year_month: r["count"] for r in tasks.monthly_activity(review).collect()} == {"2020-01": 2, None: 1}
    lvs = {r.stars: (r.avg_length, r.review_count) for r in tasks.length_vs_stars(review).collect()}
    assert lvs == {1: (7.0, 1), 5: (4.0, 1)}
    user = spark.createDataFrame(
        [("u1", "A", 10, 4.0, 3, "u2, u3", None), ("u2", "B", 0, 3.0, 1, "None", None),
         ("u3", "C", 600, 2.0, 5, None, None)], schemas.USER)
    f = tasks.fans_features(user, keep=("user_id",)).collect()
    assert [(r.user_id, r.friend_count) for r in f] == [("u1", 2)]
