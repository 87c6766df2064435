"""Vocabulary ranking, encoding and padding semantics."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratelens.operators import text


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_word_sequence_filters(spark):
    df = docs(spark, [(1, "Hello, World!  it's\tA-test\n")])
    got = df.select(text.word_sequence("text").alias("w")).collect()[0].w
    assert got == ["hello", "world", "it's", "a", "test"]


def test_vocabulary_rank_ties_by_word(spark):
    df = docs(spark, [(1, "b a c"), (2, "a b d"), (3, "c")])
    vocab = {r.word: (r.n, r.id) for r in text.fit_vocabulary(df, "text").collect()}
    # counts: a2 b2 c2 d1; equal counts ranked by the word
    assert vocab == {"a": (2, 2), "b": (2, 3), "c": (2, 4), "d": (1, 5)}


def test_num_words_cut_and_oov(spark):
    df = docs(spark, [(1, "x x x y y z"), (2, "w")])
    vocab = text.fit_vocabulary(df, "text", num_words=4)   # keeps ids 2, 3
    assert sorted(r.word for r in vocab.collect()) == ["x", "y"]
    enc = text.encode_documents(df, "text", vocab, keep=["doc_id"], length=8).orderBy("doc_id").collect()
    assert enc[0].ids == [2, 2, 2, 3, 3, 1, 0, 0] and enc[0].n_oov == 1 and enc[0].n_tokens == 6
    assert enc[1].ids == [1, 0, 0, 0, 0, 0, 0, 0]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=300), min_size=1, max_size=4))
def test_pad_truncate_always_length(spark, sizes):
    rows = [(i, list(range(2, 2 + n))) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "id int, ids array<int>")
    out = df.select("id", text.pad_truncate("ids", 200).alias("p")).orderBy("id").collect()
    for (i, n), r in zip([(i, n) for i, n in enumerate(sizes)], out):
        assert len(r.p) == 200
        assert r.p[: min(n, 200)] == list(range(2, 2 + min(n, 200)))
        assert all(v == 0 for v in r.p[min(n, 200):])


def test_whole_text_encoded(spark):
    long = " ".join(["w%d" % (i % 50) for i in range(30000)])
    df = docs(spark, [(1, long)])
    vocab = text.fit_vocabulary(df, "text")
    r = text.encode_documents(df, "text", vocab, keep=["doc_id"]).collect()[0]
    assert r.n_tokens == 30000 and r.n_oov == 0 and len(r.ids) == 200


def test_stop_words_list_matches_spark(spark):
    from pyspark.ml.feature import StopWordsRemover
    assert list(text.stop_words()) == StopWordsRemover.loadDefaultStopWords("english")
    df = spark.createDataFrame([(["the", "cat", "is", "here"],)], "w array<string>")
    assert df.select(text.without_stop_words("w").alias("f")).collect()[0].f == ["cat"]
    _ = F  # keep import for readers


def test_encoder_save_load(spark, tmp_dir):
    df = docs(spark, [(1, "x x y"), (2, "y z")])
    vocab = text.fit_vocabulary(df, "text")
    text.save_encoder(vocab, f"{tmp_dir}/enc", max_length=7)
    v2, cfg = text.load_encoder(spark, f"{tmp_dir}/enc")
    assert cfg == {"max_length": 7, "num_words": 20000, "oov_token": "<OOV>"}
    a = text.encode_documents(df, "text", vocab, keep=["doc_id"], length=cfg["max_length"]).orderBy("doc_id")
    b = text.encode_documents(df, "text", v2, keep=["doc_id"], length=cfg["max_length"]).orderBy("doc_id")
    assert a.collect() == b.collect()
