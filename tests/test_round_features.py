"""Drifting sources, dict literals, letter values, hashed terms and the taste test."""

from __future__ import annotations

import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.functions.columns import literal_map
from ratelens.operators import aggregate, graph, text
from ratelens.sources.readers import drift_report, read_checked, read_table

SCHEMA = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("fans", T.IntegerType()),
                       T.StructField("_corrupt_record", T.StringType())])


def write_lines(path, lines):
    with open(path, "w") as out:
        out.write("\n".join(lines) + "\n")


# -- drift ----------------------------------------------------------------------------

def test_bad_records_go_whole_to_quarantine(spark, tmp_dir):
    lines = ['{"user_id": "a", "fans": 1}', '{"user_id": "b", "fans": "many"}', '{"user_id": "c"', "no json",
             '{"user_id": "d", "fans": 4, "extra": 1, "_corrupt_record": "mine"}', '{"fans": 5}']
    write_lines(f"{tmp_dir}/user.json", lines)
    got = read_checked(spark, tmp_dir, "user", f"{tmp_dir}/bad", schema=SCHEMA)
    assert got.n_bad == 3 and sorted(r.record for r in got.bad.collect()) == sorted(lines[1:4])
    assert all(r.file.endswith("user.json") for r in got.bad.collect())
    # what could be read of a record is kept beside it
    parsed = {r.record: json.loads(r.parsed) for r in got.bad.collect()}
    assert parsed[lines[1]]["user_id"] == "b"
    good = sorted(map(repr, map(tuple, got.good.collect())))
    assert good == sorted(map(repr, [("a", 1, None), ("d", 4, "mine"), (None, 5, None)]))
    with pytest.raises(ValueError):
        read_checked(spark, tmp_dir, "user", f"{tmp_dir}/bad", schema=SCHEMA, max_bad=2)


def test_csv_records_of_other_width_are_quarantined(spark, tmp_dir):
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.StringType())])
    write_lines(f"{tmp_dir}/t.csv", ["k,v", "1,a", "x,b", "3,c,d", "4,e"])
    got = read_checked(spark, tmp_dir, "t", f"{tmp_dir}/bad", fmt="csv", schema=schema)
    assert got.n_bad == 2 and sorted((r.k, r.v) for r in got.good.collect()) == [(1, "a"), (4, "e")]


def test_own_files_fail_at_once(spark, tmp_dir):
    write_lines(f"{tmp_dir}/predictions.json", ['{"text": "a", "true_stars": "five"}'])
    with pytest.raises(Exception):
        read_table(spark, tmp_dir, "predictions", "json").collect()
    assert read_table(spark, tmp_dir, "predictions", "json", mode="PERMISSIVE").count() == 1


def test_drift_report_names_fields(spark, tmp_dir):
    write_lines(f"{tmp_dir}/user.json", ['{"user_id": "a", "new": 1}', '{"user_id": "b", "fans": null, "new": {"x": 1}}', "broken {", "[1]"])
    schema = T.StructType(SCHEMA.fields[:2])
    got = {(r.field, r.kind): r.n for r in drift_report(spark, tmp_dir, "user", schema).collect()}
    assert got == {("new", "unknown"): 2, ("fans", "missing"): 1}


# -- dict literals -----------------------------------------------------------------------

def test_literal_map(spark):
    cases = {
        "{'lot': True, 'valet': False}": {"lot": True, "valet": False},
        "{u'lot': True, u'kind': u'free', 'n': 3, 'x': None}": {"lot": True, "kind": None, "n": None, "x": None},
        "{'a': {'b': True, 'c': False}, 'd': True}": {"a.b": True, "a.c": False, "d": True},
        """{'parking': "{'lot': True, 'street': False}", 'wifi': u'no'}""": {"parking.lot": True, "parking.street": False, "wifi": None},
        "{'k': True, 'k': False}": {"k": False},
        "{}": {}, "  {'s': True}": {"s": True}, "None": None, "": None, "True": None, "{'a': {}}": {},
        "{'name': 'True, False'}": {"name": None},
    }
    rows = [(k,) for k in [*cases, None]]
    got = {r.t: r.m for r in spark.createDataFrame(rows, "t string").select("t", literal_map("t").alias("m")).collect()}
    assert got == {**cases, None: None}
    assert dict(spark.createDataFrame(rows, "t string").select(literal_map("t").alias("m")).dtypes) == {"m": "map<string,boolean>"}


# -- letter values -----------------------------------------------------------------------

def test_letter_values_are_order_statistics(spark):
    values = [((k * 7919) % 1000) / 4 for k in range(1000)] + [5.0] * 500
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got = aggregate.letter_values(df, "x").collect()
    ordered = sorted(values)
    assert max(r.depth for r in got) == int(math.log2(1500)) - 2 and len(got) == 2 * max(r.depth for r in got) - 1
    for r in got:
        assert r.value == ordered[max(1, math.ceil(r.probability * 1500)) - 1] and r.n == 1500
        assert r.n_below == sum(v < r.value for v in values) and r.n_up_to == sum(v <= r.value for v in values)
    assert aggregate.letter_values(df.limit(0), "x").collect() == []
    assert [r.value for r in aggregate.letter_values(df.filter("x = 5").limit(1), "x").collect()] == [5.0]


def test_sketch_keeps_its_rank_error_on_many_rows(spark):
    """Far more rows than the sketch's accuracy, over many partitions: the error is measured by exact ranks."""
    df = spark.range(0, 200_000, numPartitions=16).selectExpr("(id * 48271) % 200003 AS x")
    for accuracy in (50, 500):
        got = aggregate.letter_values(df, "x", accuracy).collect()
        assert len(got) == 2 * (int(math.log2(200_000)) - 2) - 1
        errors = [max(0.0, r.n_below - r.probability * r.n, r.probability * r.n - r.n_up_to) for r in got]
        assert max(errors) <= 200_000 / accuracy + 1
        assert sorted(r.value for r in got) == [r.value for r in sorted(got, key=lambda r: r.probability)]


def test_a_value_outside_its_bound_raises(spark, monkeypatch):
    real = F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda x, p, a: F.transform(real(x, p, a), lambda v: v + 100))
    with pytest.raises(ArithmeticError):
        aggregate.letter_values(spark.range(1000).withColumnRenamed("id", "x"), "x")


# -- hashed terms ------------------------------------------------------------------------

def test_hashed_terms_equal_a_loop(spark):
    docs = [(1, "Apple pear apple the"), (2, "pear  plum"), (3, None), (4, " "), (5, "Plum " * 50 + "fig\n")]
    df = spark.createDataFrame(docs, "k long, t string")
    words = sorted({w for _, t in docs if t for w in t.lower().split()})
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in [*words, ""]], "w string").select(
        "w", text.term_bucket("w", 3).alias("b")).collect()}
    counts = {1: Counter("apple pear apple".split()), 2: Counter(["pear", "", "plum"]), 4: Counter([""]), 5: Counter(["plum"] * 50 + ["fig"])}
    tf = {k: Counter() for k in counts}
    for k, c in counts.items():
        for w, n in c.items():
            tf[k][bucket[w]] += n
    got = {(r.k, r.bucket): (r.tf, r.weight) for r in text.hashed_tfidf(df, "k", "t", 3).collect()}
    dfreq = Counter(b for c in tf.values() for b in c)
    assert got == {(k, b): (n, pytest.approx(n * math.log(5 / (dfreq[b] + 1)), abs=1e-6)) for k, c in tf.items() for b, n in c.items()}
    shared = {r.bucket: (r.n_terms, r.n_docs, r.n_tokens) for r in text.bucket_collisions(df, "k", "t", 3).collect()}
    terms = {w for c in counts.values() for w in c}
    assert shared == {b: (sum(bucket[w] == b for w in terms), sum(b in c for c in tf.values()), sum(c[b] for c in tf.values())) for b in dfreq}


# -- taste ---------------------------------------------------------------------------------

def test_taste_test_equals_the_full_table(spark):
    cells = {("a", "x"): 30, ("a", "y"): 10, ("b", "x"): 5, ("b", "z"): 25, ("c", "y"): 7}
    cc = spark.createDataFrame([(*k, n) for k, n in cells.items()] + [(None, "x", 4)], "community string, category string, n long")
    total, own, whole = sum(cells.values()), Counter(), Counter()
    for (c, k), n in cells.items():
        own[c] += n
        whole[k] += n
    chi, js = {}, {}
    for c in own:
        expected = {k: own[c] * whole[k] / total for k in whole}
        chi[c] = sum((cells.get((c, k), 0) - e) ** 2 / e for k, e in expected.items())
        p, q = {k: cells.get((c, k), 0) / own[c] for k in whole}, {k: whole[k] / total for k in whole}
        js[c] = sum((p[k] * math.log2(2 * p[k] / (p[k] + q[k])) if p[k] else 0) + q[k] * math.log2(2 * q[k] / (p[k] + q[k])) for k in whole) / 2
    got = {r.community: r for r in graph.taste_test(cc, 9).collect()}
    assert set(got) == set(own)
    for c, r in got.items():
        assert r.n == own[c] and r.categories == sum(x == c for x, _ in cells)
        assert r.chi_square == pytest.approx(chi[c], abs=1e-6) and r.js_divergence == pytest.approx(js[c], abs=1e-6)
    one = graph.taste_association(cc, 9).first()
    assert (one.n, one.communities, one.categories, one.degrees) == (total, 3, 3, 4)
    assert one.chi_square == pytest.approx(sum(chi.values()), abs=1e-6)
    assert one.cramers_v == pytest.approx(math.sqrt(sum(chi.values()) / (total * 2)), abs=1e-6)


def test_equal_tastes_and_single_communities(spark):
    cc = spark.createDataFrame([(c, k, n * m) for c, m in (("a", 1), ("b", 3)) for k, n in (("x", 2), ("y", 5))],
                               "community string, category string, n long")
    assert {(r.chi_square, r.js_divergence) for r in graph.taste_test(cc).collect()} == {(0.0, 0.0)}
    assert graph.taste_association(cc).first().cramers_v == 0
    alone = graph.taste_association(cc.filter("community = 'a'")).first()
    assert alone.degrees == 0 and alone.cramers_v is None
    empty = graph.taste_association(cc.limit(0)).first()
    assert empty.communities == 0 and graph.taste_test(cc.limit(0)).collect() == []
