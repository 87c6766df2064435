"""The whole job where an operator once did a part of it."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_MID
from ratelens.llm import common, ngram_join
from ratelens.llm import quality_mil as mil
from ratelens.llm import quality_rules as rules
from ratelens.llm import registry
from ratelens.llm import toxicity as tox


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def plain_kept(docs, size, percent):
    """Ids that are the least of their group, from every pair with a shared shingle."""
    sets = {i: shingles(t, size) for i, t in docs}
    holders, least = {}, {i: i for i in sets}
    for i, own in sets.items():
        for g in own:
            holders.setdefault(g, []).append(i)

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, own in sets.items():
        for j in {j for g in own for j in holders[g] if j < i}:
            both = len(own & sets[j])
            if 100 * both >= percent * (len(own) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                least[b] = a
    return sorted(i for i in sets if find(i) == i)


# -- pipeline: near duplicates on five words and 0.8 ------------------------------------

def test_pipeline_drops_near_copies_of_five_words_and_four_fifths(spark):
    import corpus_pipeline
    base = [f"w{i}" for i in range(104)]
    docs = [(1, " ".join(base)), (2, " ".join(base + [f"z{i}" for i in range(22)])),  # 0.82: appended
            (3, " ".join(base[:86])),  # 0.82 of the first: cut off
            (4, " ".join(f"v{i}" for i in range(100))),
            (5, " ".join(f"v{i}" for i in range(75)))]  # 0.74: stays
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.ngram_join_stage(spark, frame, SF_MID).collect())
    assert got == plain_kept(docs, 5, 80) == [1, 4, 5]


def test_pipeline_near_duplicates_of_a_table_equal_all_pairs(spark):
    import corpus_pipeline
    frame = spark.read.parquet(f"{SF_MID}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    got = sorted(r.doc_id for r in corpus_pipeline.ngram_join_stage(spark, frame, SF_MID).collect())
    assert got == plain_kept(docs, 5, 80)


# -- quality rules: a training text counts to its end ---------------------------------------

def test_field_learns_from_the_end_of_long_texts(spark):
    plain = "\n".join(f"line {i} of plain words that say a thing" for i in range(30))
    poor = plain + "\n" + "\n".join(f"### $$$ *** footer {i}" for i in range(30))
    docs = spark.createDataFrame([(i, poor if i % 2 else plain) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, quality int")
    field = rules.fit(docs, labels)
    symbols = rules.FEATURES.index("symbols")
    assert field.emission[symbols, rules.BOILERPLATE] > field.emission[symbols, rules.CONTENT] + 1


# -- quality classifier: a training text counts to its end -----------------------------------

def test_classifier_learns_from_the_end_of_long_texts(spark):
    rows = spark.range(400).withColumnRenamed("id", "doc_id")
    labels = rows.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    tail = F.when(F.col("doc_id") % 2 == 0, F.repeat(F.lit("||| "), 64 * 6)).otherwise(F.repeat(F.lit("fine "), 64 * 6))
    docs = rows.select("doc_id", F.concat(F.repeat(F.lit("word "), 64 * 64), tail).alias("text"))
    model = mil.fit(docs, labels)
    good, poor = model.scores([mil.passages(("word " * 64 * 64 + x * 64 * 6).encode()) for x in ("fine ", "||| ")])
    assert good > 0.8 and poor < 0.2


# -- toxicity: few positives teach as well ----------------------------------------------------

def test_support_follows_the_number_of_positives():
    assert [tox.support(n) for n in (0, 1, 2, 3, 9, 37, 48, 72, 1500)] == [2, 2, 2, 3, 3, 3, 4, 6, 6]


def test_five_positives_teach_their_common_word():
    rng = np.random.default_rng(5)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]

    def bag(*more):
        words = [*rng.choice(vocabulary, 6), *more]
        return np.array([tox.word_buckets(w) for w in words], "<i4")

    model = tox.fit_bags([bag("nastyword") for _ in range(5)], [bag() for _ in range(100)], 0.1)
    score = model.scorer()
    assert score(b"so nastyword here") >= tox.THRESHOLD > score(b"so plain here")


def test_toxicity_query_on_a_small_table(spark):
    rows = (registry.op4_toxicity(spark, SF_MID).filter("held_out")
            .join(spark.read.parquet(f"{SF_MID}/labels.parquet"), "doc_id").collect())
    toxic, clean = ([r.score for r in rows if r.toxic == k] for k in (1, 0))
    assert np.mean([s >= tox.THRESHOLD for s in toxic]) > 0.8 and max(clean) < tox.THRESHOLD


# -- n-gram join: rows that share an id, or have none -------------------------------------------

def test_one_row_of_a_group_stays_whatever_its_id(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (7, a + " more"), (7, b), (7, b), (None, a), (None, b + " too"), (None, "c " * 9),
            (None, "c " * 9), (None, " "), (None, None), (3, ""), (3, "")]
    got = ngram_join.keep(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, a), (7, b), (None, "c " * 9), (None, " "), (None, None), (3, "")]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_texts_of_one_id_are_not_multiplied(spark, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join(base[:k] + ["x"] + base[k + 1:])) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, mapped = [], ngram_join.mapped

    def counted(df, fn, schema):
        if schema == "sig long, s binary":
            seen.append(df.count())
        return mapped(df, fn, schema)

    monkeypatch.setattr(ngram_join, "mapped", counted)
    got = ngram_join.components(docs).collect()
    assert len(got) == len(rows) and seen and max(seen) <= len(rows)


# -- samples: repeated rows neither pass the bound nor fill the sample ---------------------------

def repeated(spark):
    """One id on 300 rows of one text, one on 300 of different texts, and 60 others."""
    rows = [(0, "copy")] * 300 + [(1, f"text {k}") for k in range(300)] + [(i, f"own {i}") for i in range(2, 62)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(62)], "doc_id long, quality int, toxic int")
    return spark.createDataFrame(rows, "doc_id long, text string"), labels


def test_labelled_sample_holds_its_bound_with_repeats(spark):
    docs, labels = repeated(spark)
    own = labels.filter(common.fold("doc_id") != 2)
    got = common.labelled_sample(docs, own, "quality", 50).collect()
    assert len(got) <= 50 and len({(r.doc_id, r.text) for r in got}) == len(got)
    every = common.labelled_sample(docs, own, "quality", 1000).collect()
    assert {r.doc_id for r in every} == {r.doc_id for r in own.collect()}
    assert sum(r.doc_id == 0 for r in every) <= 1


def test_unlabelled_sample_is_not_filled_by_one_id(spark, monkeypatch):
    docs, labels = repeated(spark)
    got = {}
    monkeypatch.setattr(tox, "fit_bags", lambda p, u, prior, **k: got.update(p=p, u=u))
    many = docs.filter("doc_id <> 1").unionByName(docs.filter("doc_id = 0"))
    tox.fit(many, labels, positives=40, unlabelled=40)
    assert len(got["p"]) <= 40 and len(got["u"]) == 40
