"""Conversation prefix trie against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ratelens.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn int, role string, text string"


def key(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def plain(rows):
    """Node tuples from (conv_id, turn, role, text) rows; also prefix -> (conv_id, depth)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, key(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - int(c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:])
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    nodes = [(min(own_), len(p), min(members[p[:-1]]) if p else None, len(own_), len(kids.get(p, [])), leaves[p], saved[p],
              hashlib.sha256(",".join(str(c) for c in sorted(own_) if built[c] == p).encode()).hexdigest())
             for p, own_ in members.items()]
    return nodes, {(min(own_), len(p)): p for p, own_ in members.items()}


def same(got, rows):
    assert sorted(map(repr, (tuple(r) for r in got.select(*ct.NODE).collect()))) == sorted(map(repr, plain(rows)[0]))


def sample(seed, convs, words, most):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for turn in range(rng.randrange(1, most)):
            rows.append((c, turn, rng.choice(["user", "bot"]), rng.choice(words)))
    return rows


@pytest.mark.parametrize("shards", [1, 2, 40])
def test_shared_prefixes_equal_the_dictionary(spark, shards):
    rows = sample(1, range(0, 700, 3), ["a", "bb", "ccc"], 9)
    got = ct.trie(spark.createDataFrame(rows, SCHEMA).repartition(3), min_shards=shards)
    same(got, rows)


def test_a_table_equals_the_dictionary(spark):
    table = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    same(ct.trie(table), [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_a_third_of_the_conversations_are_one(spark, monkeypatch):
    """Copies of one conversation are split over shards, and its ends are hashed in runs."""
    monkeypatch.setattr(ct, "RUN", 16)
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(8)] + sample(2, range(300, 900), ["x", "y"], 12)
    frame = spark.createDataFrame(rows, SCHEMA)
    same(ct.trie(frame, min_shards=30), rows)
    paths = ct.rebuilt_paths(frame)
    shards = ct.skeleton(paths, min_shards=30)
    hot = max(sum(1 for s in shards.splitters if s[0] == p) for p in {s[0] for s in shards.splitters})
    assert hot >= 5  # several splitters inside the copies
    sizes = [r["count"] for r in ct.local_nodes(paths, shards).filter("kind = 1 AND skeleton = 0")
             .groupBy("conv_id").count().collect()]
    assert len(sizes) >= 20


def test_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (0, None, None, None), (0, 0, "user", "a"), (0, 0, "user", "a"), (0, 0, "bot", "a"),
            (1, 2, "user", ""), (1, 1, None, "é中\x00"), (2, 5, "user", "x" * 30_000), (-7, 1, "user", "a"), (-7, 2, "r", "b"),
            (100, 1, "user", "only base"), (101, 1, "user", "t1"), (205, 1, "user", "base is absent"), (7, None, "user", "a")]
    # their base is absent: those that skip their one turn have none
    rows += [(c, 1, "user", "one") for c in range(301, 330)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns(
        {"own": F.lit(1), "path": F.lit("p"), "chars": F.lit("c"), "key": F.lit(None).cast("string"), "shard": F.lit(3), "_base": F.lit(0)})
    same(ct.trie(frame, min_shards=4), rows)
    assert any(r[1] == 0 and r[7] != ct.NO_ENDS for r in plain(rows)[0])
    assert ct.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert ct.trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []


def test_any_skeleton_gives_the_same_nodes(spark):
    rows = sample(3, range(200), ["a", "b"], 7)
    frame = spark.createDataFrame(rows, SCHEMA)
    for most in (1, 5, 10_000):
        same(ct.trie(frame, min_shards=25, most=most), rows)
    deep = [(bytes([i]) * 16 * 50, i, [1] * 50) for i in range(20)]
    assert len(ct.skeleton_of(deep, 10, 200).parents) <= 200 < len(ct.skeleton_of(deep, 10, 10_000).parents)


def test_nodes_get_their_last_turn(spark):
    rows = sample(4, list(range(0, 300, 7)) + [100, 200], ["a", "b", "c"], 8)
    frame = spark.createDataFrame(rows, SCHEMA)
    nodes = ct.trie(frame, min_shards=3)
    prefix = plain(rows)[1]
    got = ct.last_turns(nodes.withColumn("text2", F.lit(1)), frame).collect()
    assert len(got) == nodes.count()
    for r in got:
        want = prefix[r.conv_id, r.depth]
        assert (r.role, r.text) == (want[-1] if want else (None, None))
