from __future__ import annotations

import io
import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF_SMALL
from llm_fixtures import no_docs, odd_docs  # noqa: F401
from ratelens.llm import encoding, length_buckets, registry, token_counts, token_pack

PATH = encoding.default_path()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def plain_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB'sSrelmv\t \n.,1é́ΣİǅßÅ<|endoftext|>\x1c\x85\xa0ñ…中2ᾳ\x7f\x00²½"), max_size=30))
def test_words_alone_give_the_whole_texts_ids(text):
    e = encoding.encoder(PATH)
    assert e.by_word
    assert np.frombuffer(e.ids(text.encode()), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_small_memory_gives_the_same_ids():
    small, usual = encoding.Encoder(PATH, remembered=3), encoding.encoder(PATH)
    for text in (b"one two three four five, six. seven", b"one two", b"Acht neun zehn elf zw\xc3\xb6lf"):
        assert small.ids(text) == usual.ids(text)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 32), st.data())
def test_pack_round_trip(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2 ** bits - 1), max_size=70)), "<u4")
    packed = token_pack.pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    assert token_pack.unpack(packed, bits, len(ids)).tolist() == ids.tolist()


def test_bits_and_overflow():
    assert [token_pack.bits_for(n) for n in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]
    with pytest.raises(ValueError):
        token_pack.pack(np.array([8], "<u4"), 3)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.integers(1, 9), st.lists(st.integers(0, 30), max_size=12), st.data())
def test_file_random_access(bits, block, sizes, data):
    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 2 ** bits, n).astype("<u4") for n in sizes]
    sink = io.BytesIO()
    keep, sink.close = sink.close, lambda: None
    writer = token_pack.Writer(sink, bits, block)
    for p in parts:
        writer.write(p)
    writer.close()
    every = np.concatenate(parts) if parts else np.empty(0, "<u4")
    reader = token_pack.Reader(pa.BufferReader(sink.getvalue()), kept=2)
    assert reader.total == len(every) and reader.bits == bits
    start = data.draw(st.integers(0, len(every)))
    n = data.draw(st.integers(0, len(every) - start))
    assert reader.read(start, n).tolist() == every[start:start + n].tolist()
    with pytest.raises(IndexError):
        reader.read(0, len(every) + 1)
    del keep


def check_index(rows, texts, tokenizer):
    start = 0
    for r, text in zip(rows, texts, strict=True):
        ids = np.array([*plain_ids(tokenizer, text), 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_packed_query_equals_the_library(spark, tokenizer):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())
    got = sorted(registry.op2_bit_packing(spark, SF_SMALL).collect())
    assert [r.doc_id for r in got] == [i for i, _ in docs]
    check_index(got, [t for _, t in docs], tokenizer)


def test_packed_edge_rows(spark, odd_docs, no_docs, tokenizer):  # noqa: F811
    index = token_pack.write(odd_docs.repartition(3), PATH, 2, block_ids=100)
    got = sorted(token_pack.read(index).collect(), key=lambda r: r.start)
    want = {}
    for r in odd_docs.collect():
        want.setdefault(r.doc_id, []).append(r.text)
    assert [r.doc_id for r in got] == sorted((i for i, t in want.items() for _ in t), key=lambda i: (i is not None, i or 0))
    check_index(got, [want[r.doc_id][0] for r in got], tokenizer)
    assert token_pack.read(token_pack.write(no_docs, PATH, 2)).collect() == []


def plain_cost(lengths, counts, edges):
    return sum(c * (min(e for e in edges if e >= n) - n) for n, c in zip(lengths, counts))


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(0, 30), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 5))
def test_boundaries_are_optimal(hist, buckets):
    lengths, counts = list(hist), list(hist.values())
    plan = length_buckets.best_boundaries(lengths, counts, buckets)
    assert len(plan.boundaries) <= buckets and plan.boundaries[-1] == max(lengths)
    assert plan.padding == plain_cost(lengths, counts, plan.boundaries)
    best = min(plain_cost(lengths, counts, edges) for k in range(1, buckets + 1)
               for edges in itertools.combinations(sorted(lengths), min(k, len(lengths))) if edges[-1] == max(lengths))
    assert plan.padding == best


def check_batches(rows, lengths, context, budget):
    """Every token once, full batches but the last of a bucket, within the budget."""
    whole = {}
    for r in rows:
        whole.setdefault(r.doc_id, []).append(r.n_tokens)
        assert r.n_tokens <= r.pad_to <= context
    assert {i: sum(n) for i, n in whole.items()} == lengths
    groups = {}
    for r in rows:
        groups.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), own in groups.items():
        pad, = {r.pad_to for r in own}
        capacity = budget // max(1, pad)
        assert sorted(r.slot for r in own) == list(range(len(own))) and len(own) <= capacity
        if (bucket, batch + 1) in groups:
            assert len(own) == capacity


def test_packing_query(spark, tokenizer):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    lengths = {r.doc_id: len(plain_ids(tokenizer, r.text)) for r in docs}
    rows = registry.op3_length_buckets(spark, SF_SMALL).collect()
    check_batches(rows, lengths, length_buckets.CONTEXT, length_buckets.BUDGET)
    hist = {}
    for r in rows:
        hist[r.n_tokens] = hist.get(r.n_tokens, 0) + 1
    plan = length_buckets.best_boundaries(list(hist), list(hist.values()))
    assert sorted({r.pad_to for r in rows}) == list(plan.boundaries)
    assert sum(r.pad_to - r.n_tokens for r in rows) == plan.padding


def test_packing_edge_rows(odd_docs, no_docs):  # noqa: F811
    rows = length_buckets.pack(odd_docs.repartition(3), PATH, 64, 200, 3).collect()
    want = sum(r.n_tokens for r in token_counts.lengths(odd_docs, PATH).collect())
    assert sum(r.n_tokens for r in rows) == want
    assert len({(r.bucket, r.batch, r.slot) for r in rows}) == len(rows)
    assert length_buckets.pack(no_docs, PATH).collect() == []
    with pytest.raises(ValueError):
        length_buckets.pack(odd_docs, PATH, 64, 63)


def test_a_bucket_over_many_partitions(spark):
    parts = spark.range(5000).selectExpr("id as doc_id", "0 as piece", "cast(if(id % 3 = 0, 7, id % 50) as int) as n_tokens")
    plan = length_buckets.best_boundaries([n for n in range(50)], [1] * 50, 4)
    rows = length_buckets.batches(parts, plan, 100).collect()
    check_batches(rows, {i: 7 if i % 3 == 0 else i % 50 for i in range(5000)}, 49, 100)


def plain_sums(lengths):
    n, total = len(lengths), sum(lengths)
    out = {}
    for x in sorted(set(lengths)):
        at = [y for y in lengths if y >= x]
        kept = sum(min(y, x) for y in lengths)
        out[x] = (lengths.count(x), len(at), sum(at), n - len(at), kept, total - kept)
    return out


def test_suffix_sums_quantiles_and_limits(spark):
    rng = np.random.default_rng(4)
    lengths = [int(x) for x in rng.integers(0, 6000, 300)] + [1500] * 150
    counted = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, n_tokens long")
    sums = token_counts.suffix_sums(token_counts.histogram(counted)).cache()
    assert {r[0]: tuple(r[1:]) for r in sums.collect()} == plain_sums(lengths)
    limits = [0, 1, 1024, 1500, 1501, 9999]
    got = {r[0]: tuple(r[1:]) for r in token_counts.at_limits(sums, limits).collect()}
    for k in limits:
        kept = sum(min(x, k) for x in lengths)
        assert got[k] == (sum(x > k for x in lengths), kept, sum(lengths) - kept)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = {r.share: r.n_tokens for r in token_counts.quantiles(sums, shares).collect()}
    for s in shares:
        assert found[s] == min(x for x in lengths if sum(y <= x for y in lengths) >= s * len(lengths))


def test_token_count_query_and_edge_rows(spark, odd_docs, no_docs, tokenizer):  # noqa: F811
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    lengths = [len(plain_ids(tokenizer, r.text)) + 1 for r in docs]
    assert {r[0]: tuple(r[1:]) for r in registry.op10_token_counts(spark, SF_SMALL).collect()} == plain_sums(lengths)
    odd = [len(plain_ids(tokenizer, r.text)) for r in odd_docs.collect()]
    got = token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(odd_docs, PATH)))
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == plain_sums(odd)
    empty = token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(no_docs, PATH)))
    assert empty.collect() == []
    assert [tuple(r) for r in token_counts.quantiles(empty, [0.5]).collect()] == [(0.5, None)]
    assert [tuple(r) for r in token_counts.at_limits(empty, [9]).collect()] == [(9, 0, 0, 0)]


# -- rows that share an id, or have none ------------------------------------------------

@pytest.mark.parametrize("kind", ["one id", "no id", "one text"])
def test_a_third_of_the_rows_are_spread(spark, kind, monkeypatch):
    """The largest task of the id files and of the batches stays near the mean."""
    from ratelens.llm import length_buckets, token_pack
    hot = {"one id": lambda k: (7, f"text {k} of many"), "no id": lambda k: (None, f"text {k} of many"),
           "one text": lambda k: (7, "the same text again")}[kind]
    rows = [hot(k) for k in range(600)] + [(1000 + k, f"own words {k}") for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    before, small = spark.conf.get("spark.sql.shuffle.partitions"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    spark.conf.set(small, "false")  # these tables are small
    try:
        index = token_pack.write(docs, encoding.default_path(), 2)
        sizes = [r["count"] for r in index.groupBy("file").count().collect()]
        assert len(sizes) == 6 and max(sizes) < 1.6 * len(rows) / 6
        starts = sorted((r.start, r.n_tokens) for r in index.collect())
        assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
        ids = [r.doc_id for r in index.orderBy("start").collect()]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
        kept, real = {}, length_buckets.written
        monkeypatch.setattr(length_buckets, "written", lambda s, df, name: kept.setdefault(name, real(s, df, name)))
        plan = length_buckets.best_boundaries([3, 9], [900, 900], 2)
        parts = docs.selectExpr("doc_id", "0 AS piece", "if(doc_id is null OR doc_id = 7, 3, 9) AS n_tokens")
        got = length_buckets.batches(parts, plan, budget=36)
        assert got.count() == len(rows)
        full = got.groupBy("bucket", "batch").count().collect()
        assert max(r["count"] for r in full if r.bucket == 0) == 12
        sizes = [r["count"] for r in kept["pack-ranged"].groupBy("_p").count().collect()]
        assert len(sizes) >= 5 and max(sizes) < 1.6 * len(rows) / 6
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set(small, "true")
