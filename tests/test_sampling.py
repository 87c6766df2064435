"""Hash sampling / splitting properties."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratelens.operators.sampling import (exact_stratified_split, fold_of, hash_sample, hash_sample_n,
                                         hash_split, stratified_split)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_split_disjoint_exhaustive_layout_independent(spark):
    df = spark.range(0, 5000)
    a, b = hash_split(df, [0.8, 0.2], ["id"])
    ia, ib = ids(a), ids(b)
    assert not set(ia) & set(ib)
    assert len(ia) + len(ib) == 5000
    assert 0.75 < len(ia) / 5000 < 0.85
    a2, _ = hash_split(df.repartition(7), [0.8, 0.2], ["id"])
    assert ids(a2) == ia


@settings(max_examples=10, deadline=None)
@given(st.floats(min_value=0.05, max_value=0.95), st.integers(min_value=0, max_value=10_000))
def test_sample_fraction_and_determinism(spark, fraction, seed):
    df = spark.range(0, 2000)
    s1 = ids(hash_sample(df, fraction, ["id"], seed))
    s2 = ids(hash_sample(df.repartition(3), fraction, ["id"], seed))
    assert s1 == s2
    assert abs(len(s1) / 2000 - fraction) < 0.08


def test_sample_n_exact(spark):
    df = spark.range(0, 3000)
    got = ids(hash_sample_n(df, 250, ["id"]))
    assert len(got) == 250 and len(set(got)) == 250
    assert ids(hash_sample_n(df.repartition(5), 250, ["id"])) == got
    assert len(ids(hash_sample_n(spark.range(0, 10), 250, ["id"]))) == 10


def test_stratified_keeps_class_shares(spark):
    df = spark.range(0, 4000).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    train, test = stratified_split(df, "label", ["id"], 0.8)
    assert train.count() + test.count() == 4000
    for lab, n in ((0, 3600), (1, 400)):
        k = train.filter(F.col("label") == lab).count()
        assert 0.74 < k / n < 0.86


def test_folds_cover_all(spark):
    df = spark.range(0, 900).withColumn("fold", fold_of(["id"], 3))
    counts = {r.fold: r["count"] for r in df.groupBy("fold").count().collect()}
    assert set(counts) == {0, 1, 2} and sum(counts.values()) == 900


def test_exact_stratified_split_counts_and_stability(spark):
    df = spark.range(0, 5003).withColumn("label", (F.col("id") % 7 == 0).cast("int"))
    out = exact_stratified_split(df, "label", ["id"], 0.8)
    got = {(r.label, r.first_part): r["count"] for r in out.groupBy("label", "first_part").count().collect()}
    n1 = 5003 // 7 + 1
    n0 = 5003 - n1
    assert got == {(0, True): n0 * 8 // 10, (0, False): n0 - n0 * 8 // 10,
                   (1, True): n1 * 8 // 10, (1, False): n1 - n1 * 8 // 10}
    first = sorted(r.id for r in out.filter("first_part").select("id").collect())
    again = exact_stratified_split(df.repartition(5), "label", ["id"], 0.8)
    assert sorted(r.id for r in again.filter("first_part").select("id").collect()) == first


def test_exact_n_with_repeated_keys(spark):
    df = spark.range(5000).selectExpr("id % 20 as k", "id")
    for seed in (42, 1, 2, 3):
        assert hash_sample_n(df, 100, ["k"], seed).count() == 100
    assert hash_sample_n(df.limit(7), 100, ["k"]).count() == 7


def test_exact_split_keeps_rows_without_label(spark):
    df = spark.range(100).selectExpr("id as key", "if(id % 4 = 0, null, id % 2) as label")
    got = exact_stratified_split(df, "label", ["key"]).groupBy("label", "first_part").count().collect()
    assert {(r.label, r.first_part): r["count"] for r in got} == {
        (None, True): 20, (None, False): 5, (0, True): 20, (0, False): 5, (1, True): 40, (1, False): 10}


def test_unit_is_the_same_in_sql(spark, duck):
    from ratelens.operators.sampling import hash_unit, unit_sql
    rows = [(k, None if k % 7 == 0 else f"t{k % 50}é|") for k in range(-300, 300)]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {r.id: r.u for r in df.select("id", hash_unit(["id", "t"], 5).alias("u")).collect()}
    import pandas as pd
    given = pd.DataFrame(rows, columns=["id", "t"])  # noqa: F841
    want = dict(duck.execute(f"SELECT id, {unit_sql(['id', 't'], 5)} FROM given").fetchall())
    assert got == want and all(0 <= u < 1 for u in got.values())


def test_columns_named_like_helpers_survive(spark):
    names = ["_u", "_pid", "_pos", "_n", "_start", "_offset", "_total", "_salt", "_opid", "_stratum"]
    df = spark.range(300).selectExpr("id", "id % 3 AS label", *(f"id * 10 + {k} AS {c}" for k, c in enumerate(names)))
    got = hash_sample_n(df, 50, ["id"])
    assert got.columns == df.columns
    assert all(r[c] == r.id * 10 + k for r in got.collect() for k, c in enumerate(names))
    split = exact_stratified_split(df, "label", ["id"], 0.5)
    assert split.columns == [*df.columns, "first_part"]
    assert all(r[c] == r.id * 10 + k for r in split.collect() for k, c in enumerate(names))


def test_exact_split_with_one_repeated_key(spark, monkeypatch):
    """A key that a third of all rows repeat is spread over the ranges."""
    from ratelens.session import RoundStore
    kept, real = {}, RoundStore.put
    monkeypatch.setattr(RoundStore, "put", lambda self, df, tag, keep=2: kept.setdefault(tag, real(self, df, tag, keep)))
    df = spark.range(3000).selectExpr("if(id < 1000, 0, id) AS key", "1 AS label")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        got = exact_stratified_split(df, "label", ["key"], 0.8)
        assert got.filter("first_part").count() == 2400 and got.count() == 3000
        sizes = [r["count"] for r in kept["ranged"].groupBy("_pid").count().collect()]
        assert len(sizes) == 6 and max(sizes) < 2 * 3000 / 6
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
