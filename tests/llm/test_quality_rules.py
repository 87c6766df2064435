from __future__ import annotations

import itertools
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF_MID, SF_SMALL
from llm_fixtures import no_docs, no_labels, odd_docs, some_labels  # noqa: F401
from ratelens.llm import quality_rules as q
from ratelens.llm import registry

WORD = r"[^\x20\x09-\x0D]+"


def plain_counts(text):
    """The base counts, written straight from their definition."""
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), failed)


TEXT = st.text(alphabet="abé #|!\n\t\r\x0b\x0c\x1c\x85.A1", max_size=200)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_base_counts_follow_the_definition(text):
    assert q.judge_text(text.encode(), q.FALLBACK)[:6] == plain_counts(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(-3, 3)), min_size=1, max_size=7),
       st.lists(st.integers(-2, 2), min_size=4, max_size=4))
def test_viterbi_finds_a_best_sequence(scores, trans):
    s, t = np.array(scores, float), np.array(trans, float).reshape(2, 2)

    def value(path):
        return sum(s[i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:]))

    best = max(map(value, itertools.product((0, 1), repeat=len(s))))
    assert value(q.viterbi(s, t).tolist()) == best


def test_training_learns_emissions_and_transitions():
    rng = np.random.default_rng(0)
    chains = []
    for k in range(60):
        x = rng.normal(0, 0.3, (6, q.N_FEATURES))
        x[:, 3] += k % 2
        chains.append((x, 1 - k % 2))
    field = q.fit_field(chains)
    assert all((q.viterbi(x @ field.emission, field.transition) == y).all() for x, y in chains)
    assert field.transition[0, 0] > field.transition[0, 1] and field.transition[1, 1] > field.transition[1, 0]


def test_one_class_or_no_labels_falls_back(odd_docs, no_labels):
    assert q.fit(odd_docs, no_labels) is q.FALLBACK
    assert q.fit_field([(np.ones((2, q.N_FEATURES)), 1)]) is q.FALLBACK


def test_edge_rows(odd_docs, no_docs, some_labels):
    got = q.judge(odd_docs, q.fit(odd_docs, some_labels)).collect()
    assert len(got) == odd_docs.count()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    for r in got:
        assert tuple(r[1:7]) == plain_counts(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    assert q.judge(no_docs, q.FALLBACK).collect() == []
    kept = q.keep(odd_docs, q.FALLBACK)
    assert kept.schema == odd_docs.schema
    assert kept.count() == sum(r.kept for r in q.judge(odd_docs, q.FALLBACK).collect())


def test_query_matches_definition_and_labels(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r for r in registry.op1_quality_rules(spark, SF_SMALL).collect()}
    assert got.keys() == docs.keys()
    short = [i for i in docs if len(docs[i]) < 4000]
    assert all(tuple(got[i][1:7]) == plain_counts(docs[i]) for i in short)
    rows = (registry.op1_quality_rules(spark, SF_MID).filter("not base_failed")
            .join(spark.read.parquet(f"{SF_MID}/labels.parquet"), "doc_id").collect())
    assert np.mean([r.kept == bool(r.quality) for r in rows]) > 0.95


# -- line labels by hard EM ---------------------------------------------------------

FOOTER = ("ALL RIGHTS RESERVED | TERMS | PRIVACY | COOKIES", "### FOLLOW US *** SUBSCRIBE NOW !!! ***")


def footed_docs(seed=0, n=200):
    """Good documents of plain lines, half of them with the same footer, and poor ones of such lines only."""
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "l")]
    rows, labels = [], []
    for k in range(n):
        plain = [" ".join(rng.choice(words, rng.integers(8, 14))) + "." for _ in range(rng.integers(4, 9))]
        loud = [" | ".join(w.upper() for w in rng.choice(words, 6)) + " ###" for _ in range(6)]
        good = k % 2 == 0
        rows.append((k, "\n".join([*plain, *FOOTER] if good and k % 4 == 0 else plain if good else [*loud, *FOOTER])))
        labels.append((k, int(good)))
    return rows, labels


def test_a_footer_is_marked_in_a_kept_document(spark):
    rows, labels = footed_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = q.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert field.transition[q.CONTENT, q.CONTENT] > field.transition[q.CONTENT, q.BOILERPLATE]
    got = {r.doc_id: r for r in q.judge(docs, field).collect()}
    for (k, text), (_, good) in zip(rows, labels):
        r = got[k]
        assert r.kept == bool(good)
        if good:  # the head is content, the footer (two lines) is not
            assert r.n_content_lines == r.n_lines - (2 if k % 4 == 0 else 0), text
            assert (r.content_share < 1) == (k % 4 == 0)


def test_line_labels_keep_their_documents_verdict():
    rng = np.random.default_rng(3)
    field = q.Field(rng.normal(size=(q.N_FEATURES, 2)), rng.normal(size=(2, 2)))
    for k in range(60):
        n = int(rng.integers(1, 9))
        chain = q.Chain(rng.normal(size=(n, q.N_FEATURES)), rng.integers(1, 20, n), np.arange(n, dtype=np.uint64), k % 2)
        marks = q.constrained(chain, field)
        share = chain.words[marks == q.CONTENT].sum() / chain.words.sum()
        assert share >= 0.75 if chain.label else share <= 0.25


def test_lines_of_copies_are_no_boilerplate():
    """A line recurs by its different neighbours; copies of a document repeat those, too."""
    x, words = np.zeros((4, q.N_FEATURES)), np.array([9, 9, 9, 5])
    copies = [q.Chain(x, words, np.array([1, 2, 3, 4], np.uint64), 1)] * 9
    assert all((m == q.CONTENT).all() for m in q.first_marks(copies))
    footed = [q.Chain(x, words, np.array([10 + 3 * k, 11 + 3 * k, 12 + 3 * k, 4], np.uint64), 1) for k in range(5)]
    assert all(m.tolist() == [1, 1, 1, 0] for m in q.first_marks(footed))


def test_gradient_of_changing_chains():
    """With line labels that change inside a chain the fitted field finds them."""
    rng = np.random.default_rng(1)
    chains = []
    for k in range(80):
        marks = np.array([1] * int(rng.integers(3, 7)) + [0] * int(rng.integers(2, 5)) if k % 2 else [0] * 4)
        x = rng.normal(0, 0.3, (len(marks), q.N_FEATURES))
        x[:, 3] += 1 - marks
        chains.append((x, marks))
    field = q.fit_field(chains)
    right = np.mean(np.concatenate([q.viterbi(x @ field.emission, field.transition) == m for x, m in chains]))
    assert right > 0.98


def test_many_documents_of_a_table_hold_both_kinds_of_lines(spark):
    got = registry.op1_quality_rules(spark, "/root/testdata/sf0.1")
    mixed = got.filter("content_share > 0 AND content_share < 1").count()
    assert mixed > 50
