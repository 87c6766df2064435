"""Friend graph: edges, components, label propagation."""

from __future__ import annotations

import pytest

import random

from ratelens.operators import graph


def users(spark, rows):
    return spark.createDataFrame(rows, "user_id string, friends string")


def comps(df):
    return {r.user_id: r.component for r in df.collect()}


def test_fixture_graph(spark):
    u = users(spark, [("a", "b"), ("b", "a, c"), ("c", "b"), ("d", "e"), ("e", "None"), ("f", None),
                      ("x", "missing")])
    e = graph.friend_edges(u)
    assert sorted((r.src, r.dst) for r in e.collect()) == [("a", "b"), ("b", "c"), ("d", "e")]
    c = comps(graph.connected_components(u.select("user_id"), e))
    assert c == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f", "x": "x"}


def test_long_chain_and_edge_order(spark):
    n = 300
    ids = [f"{i:04d}" for i in range(n)]
    random.Random(7).shuffle(ids)
    pairs = [(ids[i], ids[i + 1]) for i in range(n - 1)]
    random.Random(8).shuffle(pairs)
    v = spark.createDataFrame([(i,) for i in ids], "user_id string")
    e = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in pairs], "src string, dst string")
    c = comps(graph.connected_components(v, e))
    assert set(c.values()) == {"0000"}


def test_label_propagation_two_cliques(spark):
    left = ["a1", "a2", "a3", "a4"]
    right = ["b1", "b2", "b3", "b4"]
    pairs = [(x, y) for grp in (left, right) for i, x in enumerate(grp) for y in grp[i + 1:]]
    pairs.append(("a4", "b1"))
    v = spark.createDataFrame([(i,) for i in left + right + ["z"]], "user_id string")
    e = spark.createDataFrame(pairs, "src string, dst string")
    got = {r.user_id: r.community for r in graph.label_propagation(v, e).collect()}
    assert got["z"] == "z"
    assert len({got[x] for x in left}) == 1 and len({got[x] for x in right}) == 1


def test_hub_holding_a_third_of_edges(spark):
    """One user is the friend of a third of all linked users; the rest form
    chains.  Components and edge extraction stay exact."""
    hub = "h"
    leaves = [f"l{i:04d}" for i in range(400)]
    chain = [f"c{i:04d}" for i in range(800)]
    rows = [(hub, ", ".join(leaves))] + [(x, hub) for x in leaves]
    rows += [(chain[i], chain[i + 1] if i + 1 < len(chain) else "None") for i in range(len(chain))]
    u = users(spark, rows)
    e = graph.friend_edges(u)
    assert e.count() == 400 + 799
    c = comps(graph.connected_components(u.select("user_id"), e))
    assert {c[x] for x in leaves} == {"h"} and c[hub] == "h"
    assert {c[x] for x in chain} == {"c0000"}


def test_hot_key_split_path_gives_same_results(spark):
    """Force the hub through the broadcast (hot-key) path and compare with the
    default path: same edges, components and communities."""
    from ratelens.operators.skew import HotKeys
    forced = HotKeys(share=0.0, min_rows=5)
    hub = "h"
    leaves = [f"l{i:03d}" for i in range(60)]
    chain = [f"c{i:03d}" for i in range(40)]
    rows = [(hub, ", ".join(leaves))] + [(x, f"{hub}, c000") for x in leaves]
    rows += [(chain[i], chain[i + 1] if i + 1 < len(chain) else "None") for i in range(len(chain))]
    u = users(spark, rows)
    e_default = sorted(tuple(r) for r in graph.friend_edges(u).collect())
    e_forced = graph.friend_edges(u, hot=forced)
    assert sorted(tuple(r) for r in e_forced.collect()) == e_default
    assert "BroadcastHashJoin" in e_forced._jdf.queryExecution().executedPlan().toString()
    v = u.select("user_id")
    c1 = comps(graph.connected_components(v, graph.friend_edges(u)))
    c2 = comps(graph.connected_components(v, e_forced, hot=forced))
    assert c1 == c2 and set(c1.values()) == {"c000"}
    l1 = {r.user_id: r.community for r in graph.label_propagation(v, graph.friend_edges(u)).collect()}
    l2 = {r.user_id: r.community for r in graph.label_propagation(v, e_forced, hot=forced).collect()}
    assert l1 == l2


def test_round_limit_raises(spark):
    n = 64
    v = spark.createDataFrame([(i,) for i in range(n)], "user_id long")
    e = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "src long, dst long")
    with pytest.raises(RuntimeError):
        graph.connected_components(v, e, max_rounds=1)
    assert {r.component for r in graph.connected_components(v, e).collect()} == {0}
    with pytest.raises(RuntimeError):
        graph.label_propagation(v, e, max_rounds=1)


def test_label_cycles_are_recognised(spark):
    v = spark.createDataFrame([("a",), ("b",), ("z",)], "user_id string")
    e = spark.createDataFrame([("a", "b")], "src string, dst string")
    got = {r.user_id: (r.community, r.settled) for r in graph.label_propagation(v, e).collect()}
    # two neighbours swap labels for ever; the lone node keeps its own
    assert got == {"a": ("a", False), "b": ("a", False), "z": ("z", True)}


# -- contraction ------------------------------------------------------------------

def frames(spark, nodes, pairs):
    v = spark.createDataFrame([(i,) for i in nodes], "user_id long")
    return v, spark.createDataFrame(pairs, "src long, dst long")


@pytest.mark.parametrize("shape", ["path", "star"])
def test_written_edges_fall_every_round(spark, shape):
    n = 400
    pairs = [(i, i + 1) for i in range(n - 1)] if shape == "path" else [(n // 2, i) for i in range(n) if i != n // 2]
    random.Random(3).shuffle(pairs)
    v, e = frames(spark, range(n), pairs)
    trace = []
    assert {r.component for r in graph.connected_components(v, e, trace=trace).collect()} == {0}
    assert trace[0] == n - 1 and trace[-1] == 0
    assert all(a > b for a, b in zip(trace, trace[1:]))
    assert len(trace) < 12


def test_random_graph_equals_union_find(spark):
    from ratelens.operators.skew import HotKeys
    rng = random.Random(11)
    nodes = rng.sample(range(10_000), 300)
    pairs = [(rng.choice(nodes[k:k + 60]), rng.choice(nodes[k:k + 60])) for k in range(0, 300, 60) for _ in range(45)]
    pairs += [(nodes[0], x) for x in nodes[1:50]] + pairs[:10] + [(b, a) for a, b in pairs[:10]]
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        lo, hi = sorted((find(a), find(b)))
        up[hi] = lo
    v, e = frames(spark, nodes, pairs)
    for hot in (HotKeys(), HotKeys(share=0.05, min_rows=3)):
        assert comps(graph.connected_components(v, e, hot=hot)) == {x: find(x) for x in nodes}
    none = graph.connected_components(v, e.limit(0))
    assert comps(none) == {x: x for x in nodes}


# -- delta label propagation ---------------------------------------------------------

def plain_labels(nodes, pairs):
    from collections import Counter
    near = {x: [] for x in nodes}
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    labels, states = {x: x for x in nodes}, []
    while labels not in states:
        states.append(labels)
        votes = {x: Counter(labels[y] for y in near[x]) for x in nodes}
        labels = {x: min((-c, y) for y, c in votes[x].items())[1] if votes[x] else labels[x] for x in nodes}
    cycle = states[states.index(labels):]
    return {x: (min(s[x] for s in cycle), len({s[x] for s in cycle}) == 1) for x in nodes}


def test_delta_votes_equal_all_votes(spark):
    from ratelens.operators.skew import HotKeys
    rng = random.Random(4)
    nodes = list(range(150))
    pairs = [tuple(sorted(rng.sample(nodes, 2))) for _ in range(130)] + [(0, x) for x in range(1, 60)]
    v, e = frames(spark, nodes, pairs)
    want = plain_labels(nodes, pairs)
    for hot in (HotKeys(), HotKeys(share=0.1, min_rows=10)):
        got = graph.label_propagation(v, e, hot=hot).collect()
        assert {r.user_id: (r.community, r.settled) for r in got} == want


def test_late_rounds_follow_the_changed_nodes(spark):
    """Many cliques settle at once, one path goes on: later rounds read the path's edges only."""
    cliques = [(c * 5 + i, c * 5 + j) for c in range(50) for i in range(5) for j in range(i + 1, 5)]
    path = [(1000 + i, 1001 + i) for i in range(10)]
    nodes = sorted({x for p in cliques + path for x in p})
    v, e = frames(spark, nodes, cliques + path)
    trace = []
    got = graph.label_propagation(v, e, trace=trace).collect()
    assert {r.user_id: (r.community, r.settled) for r in got} == plain_labels(nodes, cliques + path)
    assert trace[0] == (len(nodes), 2 * (len(cliques) + len(path)))
    assert len(trace) > 6 and all(moved <= 11 and heard <= 2 * len(path) for moved, heard in trace[3:])


def test_edges_are_not_shuffled_in_a_round(spark):
    from ratelens.session import RoundStore
    nodes = list(range(2000))
    v, e = frames(spark, nodes, [(i, i + 1) for i in range(1999)])
    store = RoundStore(spark, "votes-test")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    buckets, graph.BUCKET_ROWS = graph.BUCKET_ROWS, 10
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        votes = graph._Votes(e, store, graph.DEFAULT_HOT)
        plan = votes.of(v.select(v["user_id"].alias("u")))._jdf.queryExecution().executedPlan().toString()
        side = next(line for line in plan.splitlines() if "FileScan" in line)
        assert "Bucketed: true" in side
        # the one exchange is above the nodes, which are no file scan
        assert plan.count("Exchange hashpartitioning") == 1 and plan.index("FileScan") < plan.index("Exchange hashpartitioning")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        graph.BUCKET_ROWS = buckets
        store.close()
