"""The n-gram join's count of common n-grams: exact, and lean in memory."""
from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from ratelens.llm import ngram_join
from ratelens.llm.encoding import default_path, encoder


def test_frequent_ngrams_are_counted_in_place():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.zipf(1.3, 200).astype(np.uint64)) for _ in range(4000)]
    every, counts = np.unique(np.concatenate(sets), return_counts=True)
    often = counts >= max(3, len(sets) / 3000)
    size = sum(x.nbytes for x in sets)
    held = [x.copy() for x in sets]
    tracemalloc.start()
    keys, n = ngram_join._frequent(held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert keys.tolist() == every[often].tolist() and n.tolist() == counts[often].tolist()
    assert not held and peak < 2.2 * size


def test_few_sets_have_no_frequent_ngrams():
    one = np.array([1, 2], np.uint64)
    assert len(ngram_join._frequent([one])[0]) == 0
    keys, n = ngram_join._frequent([one, one, one])
    assert keys.tolist() == [1, 2] and n.tolist() == [3, 3]


def test_tiles_number_their_ngrams_lean():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 60_000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, 400)) for _ in range(1000)]
    sets += [np.unique(np.append(x[:-9], pool[:7])) for x in sets[::10]]
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    got = ngram_join._numbered(sets, size)
    assert got[0].tolist() == flat.tolist()
    assert got[1].tolist() == np.repeat(np.arange(len(sets)), size)[order].tolist()
    assert got[2].tolist() == np.searchsorted(flat[order], np.arange(len(names) + 1)).tolist()
    tracemalloc.start()
    links = ngram_join.spanning_links(sets, np.arange(len(sets)), 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(tuple(sorted(x)) for x in links) == [(10 * k, 1000 + k) for k in range(100)]
    assert peak < 4 * size.sum() * 8


def test_a_worker_gives_back_what_earlier_tasks_left():
    encoder(default_path()).ids(b"some words of an earlier task")
    assert encoder.cache_info().currsize
    one = pa.record_batch([pa.array([1, 2])], ["a"])
    out = list(ngram_join._lean(lambda it: (x.slice(1) for x in it))(iter([one])))
    assert [x.to_pylist() for x in out] == [[{"a": 2}]]
    assert not encoder.cache_info().currsize
