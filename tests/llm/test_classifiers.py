from __future__ import annotations

import zlib

import numpy as np
import pytest

from conftest import SF_MID
from llm_fixtures import no_docs, no_labels, odd_docs, some_labels  # noqa: F401
from ratelens.llm import quality_mil as mil
from ratelens.llm import registry
from ratelens.llm import toxicity as tox


def test_mil_gradients_match_differences():
    rng = np.random.default_rng(0)
    w = {"E": rng.normal(size=(5, 4)), "V": rng.normal(size=(4, 3)), "U": rng.normal(size=(4, 3)),
         "w": rng.normal(size=3), "c": rng.normal(size=4), "b": np.array([0.3])}
    x, starts, y = rng.normal(size=(6, 5)), np.array([0, 1, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = mil._forward(w, x, starts)[0]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = mil._gradients(w, x, starts, y)
    for name, value in w.items():
        for at in list(np.ndindex(value.shape))[:6]:
            old = value[at]
            value[at] = old + 1e-6
            up = loss()
            value[at] = old - 1e-6
            slope = (up - loss()) / 2e-6
            value[at] = old
            assert g[name][at] == pytest.approx(slope, abs=1e-5)


def test_attention_finds_the_one_telling_passage():
    rng = np.random.default_rng(1)
    bags, labels = [], []
    for k in range(300):
        bag = rng.normal(0, 0.1, (rng.integers(1, 8), mil.N_FEATURES)).astype(np.float32)
        if k % 2:
            bag[rng.integers(len(bag)), 0] += 3
        bags.append(bag)
        labels.append(k % 2)
    model = mil.fit_bags(bags, labels)
    assert np.mean((model.scores(bags) >= 0.5) == np.array(labels)) > 0.95


def test_passages_cover_whole_texts():
    words = [f"w{i}" for i in range(130)]
    assert mil.passages(" ".join(words).encode()).shape == (3, mil.N_FEATURES)
    long = ("word " * 64 * 50 + "|||| " * 64).encode()
    assert mil.passages(long)[-1, 0] > 0.5 and mil.passages(long)[0, 0] == 0
    assert not mil.passages(b"").any() and not mil.passages(b" \n ").any()


def rows_of(bag):
    return np.array([tox.word_buckets(w) for w in bag], "<i4").reshape(-1, tox.N_KINDS)


def test_pu_learning_finds_the_positive_words():
    rng = np.random.default_rng(2)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]

    def bag(toxic):
        words = list(rng.choice(vocabulary, 12))
        return words + (["nastyword"] if toxic else [])

    positive = [rows_of(bag(True)) for _ in range(150)]
    unlabelled = [bag(k % 5 == 0) for k in range(600)]
    model = tox.fit_bags(positive, [rows_of(b) for b in unlabelled], 0.2)
    score = model.scorer()
    assert min(score(" ".join(bag(True)).encode()) for _ in range(50)) >= 0.3
    assert max(score(" ".join(bag(False)).encode()) for _ in range(50)) < 0.3


def test_pu_gradients_match_differences():
    rng = np.random.default_rng(3)
    bags = [rng.integers(1, 6, (n, tox.N_KINDS)) for n in (3, 1, 4)]
    w = rng.normal(-1, 0.3, 8)
    w[0] = 0
    for toxic in (True, False):
        _, g = tox._risk_gradients(bags, w, toxic)
        for k in range(1, len(w)):
            up, down = w.copy(), w.copy()
            up[k] += 1e-6
            down[k] -= 1e-6
            slope = (tox._risk_gradients(bags, up, toxic)[0] - tox._risk_gradients(bags, down, toxic)[0]) / 2e-6
            assert g[k] == pytest.approx(slope, abs=1e-5)


@pytest.mark.parametrize("module", [mil, tox])
def test_edge_rows(module, odd_docs, no_docs, some_labels, no_labels):
    for labels in (some_labels, no_labels):
        got = module.score(odd_docs, module.fit(odd_docs, labels)).collect()
        assert len(got) == odd_docs.count()
        for r in got:
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD)
            assert r.doc_id is None or r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert module.score(no_docs, module.fit(no_docs, some_labels)).collect() == []


def test_same_rows_same_scores(odd_docs, some_labels):
    a = {(r.doc_id, r.score) for r in tox.score(odd_docs, tox.fit(odd_docs, some_labels)).collect()}
    b = {(r.doc_id, r.score) for r in tox.score(odd_docs.repartition(5), tox.fit(odd_docs.repartition(3), some_labels)).collect()}
    assert a == b


def test_held_out_accuracy_of_the_classifier_query(spark):
    rows = (registry.op7_quality_classifier(spark, SF_MID).filter("held_out")
            .join(spark.read.parquet(f"{SF_MID}/labels.parquet"), "doc_id").collect())
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9


def test_toxicity_query_ranks_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = (registry.op4_toxicity(spark, sf).filter("held_out")
            .join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect())
    toxic = [r.score for r in rows if r.toxic]
    clean = [r.score for r in rows if not r.toxic]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.95
    assert np.mean([s >= 0.3 for s in clean]) < 0.02 and np.mean([s >= 0.3 for s in toxic]) > 0.8


def test_scores_equal_the_definition(spark):
    """The query's scores against a loop over words: strong shares add up, weak ones count by their mean."""
    import math
    from conftest import SF_SMALL
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    model = tox.fit(docs, labels)
    got = {r.doc_id: r.score for r in tox.score(docs, model).collect()}
    for r in docs.collect():
        strong, weak = 0.0, []
        for word in {w.strip(tox._OUTER) for w in (r.text or "").lower().split()} - {""}:
            known = [model.weights[b] for b in tox.word_buckets(word) if b in model.weights]
            if known:
                share = math.log1p(math.exp(min(30.0, model.word_bias + sum(known))))
                strong, weak = (strong + share, weak) if share >= tox.FLOOR else (strong, [*weak, share])
        want = 1 - math.exp(-math.log1p(math.exp(model.text_bias)) - strong - (sum(weak) / len(weak) if weak else 0.0))
        assert abs(got[r.doc_id] - want) < 1e-9


def test_bag_scores_equal_the_definition(spark):
    """Gated attention over all passages of a document, passage by passage."""
    import math
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma", "|||", "###"], 60 + 40 * (k % 9))), k % 2) for k in range(80)]
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = mil.fit(frame, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int"))
    w = {k: v.astype(float) for k, v in model.weights.items()}
    got = {r.doc_id: r.score for r in mil.score(frame, model).collect()}
    for k, text, _ in rows:
        parts = []
        for x in mil.passages(text.encode()):
            h = [math.tanh(sum(((x - model.mean) * model.scale) * w["E"][:, j])) for j in range(w["E"].shape[1])]
            gate = [math.tanh(np.dot(h, w["V"][:, j])) / (1 + math.exp(-np.dot(h, w["U"][:, j]))) for j in range(len(w["w"]))]
            parts.append((math.exp(np.dot(gate, w["w"])), h))
        total = sum(e for e, _ in parts)
        z = sum(e / total * np.array(h) for e, h in parts)
        assert abs(got[k] - 1 / (1 + math.exp(-(np.dot(z, w["c"]) + w["b"][0])))) < 1e-3
