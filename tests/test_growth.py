"""Steps whose cost must follow the input: what goes through the driver, and work per token."""
from __future__ import annotations

from pyspark.sql import functions as F

from ratelens.operators import graph
from ratelens.operators.skew import HotKeys, split_join
from ratelens.session import RoundStore


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cold_side_of_split_join_is_not_broadcast(spark):
    big = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    keyed = spark.range(7).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    for how in ("inner", "left", "left_semi"):
        assert "BroadcastHashJoin" not in _plan(split_join(big, keyed, "k", [], how))
    plan = _plan(split_join(big, keyed, "k", [3]))
    assert plan.count("BroadcastHashJoin") == 1 and plan.count("SortMergeJoin") == 1


def test_votes_and_labels_are_not_broadcast(spark):
    edges = spark.createDataFrame([("1", "2"), ("2", "3")], "src string, dst string")
    votes = graph._Votes(edges, RoundStore(spark, "test-votes"), HotKeys())
    nodes = spark.createDataFrame([("1",)], "u string")
    assert "BroadcastHashJoin" not in _plan(votes.of(nodes))
    assert sorted(map(tuple, votes.of(nodes).collect())) == [("1", "2")]


def test_taste_counts_broadcast_nothing(spark):
    communities = spark.createDataFrame([("1", "1"), ("2", "1"), ("3", "3")], "user_id string, community string")
    orders = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "o_orderkey long, o_custkey long")
    lines = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (3, 1)], "l_orderkey long, l_partkey long")
    part = spark.createDataFrame([(1, "a"), (2, "b")], "p_partkey long, p_type string")
    counts = graph.category_counts(communities, orders, lines, part, community="community")
    assert "BroadcastHashJoin" not in _plan(counts)
    assert sorted(map(tuple, counts.collect())) == [("1", "a", 2), ("1", "b", 1), ("3", "a", 1)]


def test_bucket_collisions_look_stop_words_up_in_a_set(spark):
    from ratelens.operators import text
    docs = spark.createDataFrame([(1, "The cat  the cat"), (1, "the CAT dog "), (None, "dog"), (2, None), (3, "the")],
                                 "doc_id long, text string")
    out = text.bucket_collisions(docs, "doc_id", "text")
    plan = _plan(out)
    assert "lambda" not in plan and "INSET" in plan.upper()
    want: dict[int, tuple[set, set, int]] = {}
    for key, term, n in [(1, "cat", 3), (1, "", 1), (1, "dog", 1), (None, "dog", 1)]:
        b = spark.range(1).select(text.term_bucket(F.lit(term))).first()[0]
        terms, keys, tokens = want.get(b, (set(), set(), 0))
        want[b] = (terms | {term}, keys | {key}, tokens + n)
    assert {r.bucket: (r.n_terms, r.n_docs, r.n_tokens) for r in out.collect()} == {
        b: (len(t), len(k), n) for b, (t, k, n) in want.items()}


def test_hashed_terms_are_those_of_the_pipeline_stages(spark):
    from ratelens.ml import models
    rows = [(i, x) for i, x in enumerate(["", " ", "The quick  brown fox", "a the of", "ÄÖ ß 漢字 İX \u2028 ΣΑΣ K", "x" * 999 + " yz yz yz",
                                          "\t tab\nline\x0bvt\u00a0nbsp trailing   ", "I'M i'm don't THE", "1 12 123 1234 12345 é éé ééé"])]
    df = spark.createDataFrame(rows, "k long, text string")
    stages = models.text_stages()[:-1]
    want = df
    for stage in stages:
        want = stage.transform(want)
    got = models.hashed_terms(stages, df)
    assert "Arrow" in _plan(got)
    assert {r.k: r.rawFeatures for r in got.collect()} == {r.k: r.rawFeatures for r in want.collect()}
    assert models.hashed_terms(stages, df.limit(0)).collect() == []
