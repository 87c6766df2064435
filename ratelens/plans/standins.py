"""Driver tables bound to the review data set's shapes.

The review data set itself is not shipped; these views derive review-shaped
inputs from the driver's parquet tables, with Spark, so every task's work grows
with the tables.  Mapping (one line each):

- business (volume x rating): one row per customer from ``orders``:
  ``review_count`` = orders, ``stars`` = mean of (6 - priority digit) in half steps
- review: ``documents`` joined with ``labels``: ``stars`` = 5 for quality 1 else 1
- user: ``customer`` + order aggregates + a friend list (same market segment,
  customer keys 1..3 apart) rendered as a comma-separated string
- categories: ``part.p_name`` words; attributes: texts rebuilt from ``documents``
  and ``part``; nested attributes: ``events.props`` parsed as JSON
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.operators.skew import apart
from ratelens.sources.readers import read_table

# Stand-in thresholds for the statistical anomaly classes
# (the data set's own defaults are 500 / 2.0 and 5 / 5.0).
ANOMALY_THRESHOLDS = dict(bad_min_count=14, bad_max_rating=2.5, good_max_count=5, good_rating=5.0)
# Friend links join customers of one segment whose keys are 1..3 apart.
FRIEND_KEY_OFFSETS = (1, 2, 3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def priority_stars() -> F.Column:
    """'1-URGENT' -> 5 ... '5-LOW' -> 1."""
    return F.lit(6) - F.substring("o_orderpriority", 1, 1).cast("int")


def business_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return (orders.groupBy(F.col("o_custkey").alias("business_id"))
            .agg(F.count(F.lit(1)).alias("review_count"),
                 (F.round(F.avg(priority_stars()) * F.lit(2)) / F.lit(2)).alias("stars")))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return (docs.join(labels, "doc_id")
            .select(F.col("doc_id").alias("review_id"), F.col("source").alias("business_id"),
                    F.when(F.col("quality") == 1, F.lit(5)).otherwise(F.lit(1)).alias("stars"),
                    "text", "lang", "doc_id", "quality"))


def all_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a review; stars are null where there is no label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return (docs.join(labels, "doc_id", "left")
            .select(F.col("doc_id").alias("review_id"), F.col("source").alias("business_id"),
                    F.when(F.col("quality") == 1, F.lit(5)).when(F.col("quality") == 0, F.lit(1)).alias("stars"), "text"))


def friend_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected customer pairs (a < b by key) of the synthetic friend graph.

    An equi-join on ``key + offset``: each customer is exploded into a fixed,
    small number of probe keys, so the join is a plain shuffle join on the key
    with no range condition and no pairs enumerated inside a group.
    """
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    probes = cust.select(F.col("c_custkey").alias("a"), F.col("c_mktsegment").alias("seg"),
                         F.explode(F.array(*[F.col("c_custkey") + F.lit(d) for d in FRIEND_KEY_OFFSETS])).alias("probe"))
    other = cust.select(F.col("c_custkey").alias("b"), F.col("c_mktsegment").alias("seg_b"))
    return (probes.join(apart(other), (F.col("probe") == F.col("b")) & (F.col("seg") == F.col("seg_b")))
            .select("a", "b"))


def _friends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``c_custkey, friends`` of the customers with a link."""
    pairs = friend_pairs(spark, sf_dir)
    both = pairs.select(F.col("a").alias("c_custkey"), F.col("b").alias("f")).unionByName(
        pairs.select(F.col("b").alias("c_custkey"), F.col("a").alias("f")))
    # one short list per user: the group is bounded by the degree (<= 6 here)
    return both.groupBy("c_custkey").agg(
        F.array_join(F.sort_array(F.collect_list(F.col("f").cast("string"))), ", ").alias("friends"))


def friend_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, friends`` of ``users`` (the same rows), for the graph tasks."""
    cust = table(spark, sf_dir, "customer").select("c_custkey")
    return (cust.join(apart(_friends(spark, sf_dir)), "c_custkey", "left")
            .select(F.col("c_custkey").cast("string").alias("user_id"), F.coalesce("friends", F.lit("None")).alias("friends")))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = table(spark, sf_dir, "orders")
    per_cust = (orders.groupBy(F.col("o_custkey").alias("c_custkey"))
                .agg(F.count(F.lit(1)).alias("review_count"),
                     F.round(F.avg(priority_stars()), 2).alias("average_stars"),
                     F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("fans")))
    return (cust.join(per_cust, "c_custkey", "left").join(_friends(spark, sf_dir), "c_custkey", "left")
            .select(F.col("c_custkey").cast("string").alias("user_id"),
                    F.col("c_name").alias("name"),
                    F.coalesce("review_count", F.lit(0)).alias("review_count"),
                    F.col("average_stars"),
                    F.coalesce("fans", F.lit(0)).alias("fans"),
                    F.coalesce("friends", F.lit("None")).alias("friends")))


def wifi_business(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WiFi-like repr text ``u'<lang>'`` with ``n_chars`` as the rating."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("n_chars").alias("stars"),
                       F.concat(F.lit("u'"), F.col("lang"), F.lit("'")).alias("wifi"))


def parking_business(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dict-literal parking text from ``part`` (lot = name mentions widget),
    ``p_size`` as the rating."""
    part = table(spark, sf_dir, "part")
    lot = F.when(F.col("p_name").contains("widget"), F.lit("True")).otherwise(F.lit("False"))
    return part.select(F.col("p_size").alias("stars"),
                       F.concat(F.lit("{'lot': "), lot, F.lit(", 'valet': False}")).alias("parking"))


def nested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with ``props`` parsed into a struct column ``attributes``."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_type", F.from_json("props", "k STRING").alias("attributes"))


def predictions_standin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predictions-shaped table from ``labels``: true = quality,
    predicted = not toxic."""
    lab = table(spark, sf_dir, "labels")
    return lab.select(F.col("quality").alias("true_sentiment"),
                      (F.lit(1) - F.col("toxic")).alias("predicted_sentiment")) \
        .withColumn("correct", F.col("true_sentiment") == F.col("predicted_sentiment"))


def unit_price_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline regression on ``lineitem``: price = quantity x the part's mean
    unit price.  Partial aggregate per part, then a shuffle join on the part key."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice")
    unit = li.groupBy("l_partkey").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    return (li.join(unit, "l_partkey")
            .select(F.col("l_extendedprice").alias("label"),
                    (F.col("l_quantity") * F.col("unit")).alias("prediction")))
