"""Friend graph: edges, communities and their category taste.

Iterative algorithms run as a short driver loop of DataFrame rounds (joins +
partial aggregates) whose work shrinks: components contract their edge table,
label propagation votes again only around changed nodes.  Each round's table is
written as parquet under the folder named by ``spark.checkpoint.dir`` and
re-read: lineage stays one round deep and a lost executor costs one round, not
a replay from the first scan.

Skew: a hub user (or a component holding a third of all users) is a hot join
key.  Every per-node aggregate is algebraic (min / count), so hub groups are
pre-combined map-side; every join on a node key splits its hot keys off
(``operators.skew``: degree above a share of all edges, so a bounded list,
fetched first) and joins them by broadcast, the rest by a shuffled join (which
AQE's skew handling can still split); with no hot key the join is plain.  No group is ever collected into one row.
Joins of tables that grow with the graph are never broadcast (``skew.apart``):
over all rounds they would send many times the graph through the driver.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.functions.columns import NONE_SENTINEL
from ratelens.operators.skew import HotKeys, apart, hot_keys, split_join
from ratelens.operators.topk import top_k_per_group
from ratelens.session import RoundStore

DEFAULT_HOT = HotKeys()
#: Edges in one hash bucket of a written graph table, about (at most as many buckets as shuffle partitions).
BUCKET_ROWS = 1 << 17


def friend_edges(users: DataFrame, user_id: str = "user_id", friends: str = "friends",
                 sep: str = ",", hot: HotKeys = DEFAULT_HOT) -> DataFrame:
    """Undirected, de-duplicated edges ``src < dst`` from friend-list strings;
    links to unknown users and self links are dropped.  A user named in a
    large share of all friend lists is a hot key of the existence check."""
    raw = (users.select(F.col(user_id).alias("src"), F.explode(F.split(friends, sep)).alias("dst"))
           .withColumn("dst", F.trim("dst"))
           .filter((F.col("dst") != F.lit("")) & (F.col("dst") != F.lit(NONE_SENTINEL))))
    known = users.select(F.col(user_id).alias("dst"))
    per_dst = raw.groupBy("dst").agg(F.count(F.lit(1)).alias("_deg"))
    hot_dst = hot_keys(per_dst, "dst", "_deg", raw.agg(F.count(F.lit(1))).scalar(), hot)
    ok = split_join(raw, known, "dst", hot_dst, "left_semi").filter(F.col("src") != F.col("dst"))
    return ok.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def _directed(edges: DataFrame) -> DataFrame:
    return (edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
            .unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v"))))


def _pairs(a: str, b: str, edges: DataFrame) -> DataFrame:
    """``src < dst`` of two columns, self loops dropped, de-duplicated."""
    return (edges.filter(F.col(a) != F.col(b))
            .select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct())


def _hot(counts: DataFrame, key: str, rows: int, policy: HotKeys) -> list:
    """Hot keys of ``counts`` (``key, _deg``); none of ``rows`` rows can have one while they are few."""
    return hot_keys(counts, key, "_deg", rows, policy) if rows > policy.min_rows else []


def _hooked(edges: DataFrame, k: int, hot_u: list) -> DataFrame:
    """``u, root`` for every node of ``edges``: each node hooks to the node of least hash among
    itself and its neighbours, and pointers are followed twice (each time doubling
    their reach).  Hashes fall along pointers, so no cycle arises; round ``k`` has its own hash."""
    rank = F.struct(F.xxhash64("v", F.lit(k)).alias("h"), F.col("v").alias("v"))
    own = F.struct(F.xxhash64("u", F.lit(k)).alias("h"), F.col("u").alias("v"))
    up = (_directed(edges).groupBy("u").agg(F.min(rank).alias("m"))
          .select("u", F.least(own, F.col("m")).getField("v").alias("root")))
    for _ in range(2):
        # a node's pointer is followed by at most its neighbours (the first time) or theirs
        nxt = up.select(F.col("u").alias("root"), F.col("root").alias("_next"))
        up = split_join(up, nxt, "root", hot_u).select("u", F.col("_next").alias("root"))
    return up


def connected_components(vertices: DataFrame, edges: DataFrame, node: str = "user_id",
                         max_rounds: int | None = None, hot: HotKeys = DEFAULT_HOT,
                         trace: list[int] | None = None) -> DataFrame:
    """``node, component``: component = smallest node id in its component.

    Randomised contraction (Bögeholz, Brand and Todor, "In-database connected component
    analysis", ICDE 2020): every round hooks each node to the node of least hash
    around it, follows the pointers, and relabels and de-duplicates the edges by
    the roots.  At least a third of the nodes are expected to go each round, whatever
    the graph, so rounds are O(log n) and the written edge tables shrink; only
    the table of the last round is read again.  At the end the pointer tables (one
    row per node that was left in its round) are unrolled from the last to the first.

    Every table is written to the shared checkpoint folder (lineage cut,
    restart-safe).  ``trace`` collects the edge rows of each round; with
    ``max_rounds`` a run that has edges left by then raises.
    """
    spark = vertices.sparkSession
    store = RoundStore(spark, "components")
    e = store.put(_pairs("src", "dst", edges), "edges", keep=1)
    rows = e.count()
    rounds: list[DataFrame] = []
    for step in count(1):
        if trace is not None:
            trace.append(rows)
        if not rows:
            break
        if max_rounds is not None and step > max_rounds:
            raise RuntimeError(f"components have not converged after {max_rounds} rounds")
        deg = _directed(e).groupBy("u").agg(F.count(F.lit(1)).alias("_deg"))
        hot_u = _hot(deg, "u", 2 * rows, hot)
        up = store.put(_hooked(e, step, hot_u), f"up{step}", keep=1)
        rounds.append(up)
        a, b = (up.select(F.col("u").alias(c), F.col("root").alias("_" + c)) for c in ("src", "dst"))
        e = store.put(_pairs("_src", "_dst", split_join(split_join(e, a, "src", hot_u), b, "dst", hot_u)), "edges", keep=2)
        rows = e.count()
    if not rounds:
        return store.put(vertices.select(node, F.col(node).alias("component")), "labels")

    def by_root(up: DataFrame, keyed: DataFrame) -> DataFrame:
        """``up`` joined with a row per root; a root of very many nodes goes by broadcast."""
        often = _hot(up.groupBy("root").agg(F.count(F.lit(1)).alias("_deg")), "root", up.count(), hot)
        return split_join(up, keyed, "root", often, "left")

    found = rounds[-1]
    for up in reversed(rounds[:-1]):
        later = found.select(F.col("u").alias("root"), F.col("root").alias("_later"))
        found = store.put(by_root(up, later).select("u", F.coalesce("_later", "root").alias("root")), "found", keep=2)
    least = found.groupBy("root").agg(F.least(F.min("u"), F.col("root")).alias("component"))
    labels = by_root(found, least).select(F.col("u").alias("_u"), "component")
    out = store.put(vertices.join(apart(labels), F.col(node) == F.col("_u"), "left")
                    .select(node, F.coalesce("component", node).alias("component")), "labels")
    store.drop("edges", "found", *(f"up{k}" for k in range(1, len(rounds) + 1)))
    return out


class _Votes:
    """The fixed part of a label propagation: edges by listening node.

    ``ties`` (u hears v) is bucketed by ``u``: neither finding who hears a changed node nor
    taking the edges of the nodes that vote again shuffles it.  Edges of hot
    nodes are kept beside it, evenly spread, and met by broadcast."""

    def __init__(self, edges: DataFrame, store: RoundStore, hot: HotKeys):
        kept = store.put(edges.select("src", "dst"), "pairs", keep=1)
        both, rows = _directed(kept), 2 * kept.count()
        self.hot = _hot(both.groupBy("u").agg(F.count(F.lit(1)).alias("_deg")), "u", rows, hot)
        most = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = buckets = max(1, min(most, -(-rows // BUCKET_ROWS)))
        loud = F.col("u").isin(self.hot)
        cold = both.filter(~loud) if self.hot else both.filter(F.col("u").isNotNull())
        self.ties = store.put_bucketed(cold.repartition(buckets, "u"), "ties", "u", buckets, keep=1)
        self.loud = store.put(both.filter(loud), "loud", keep=1) if self.hot else None
        store.drop("pairs")

    def of(self, nodes: DataFrame) -> DataFrame:
        """The edges (u, v) of ``nodes`` (one column ``u``, distinct)."""
        out = self.ties.join(apart(nodes), "u", "left_semi")
        if self.loud is None:
            return out
        return out.unionByName(self.loud.join(F.broadcast(nodes.filter(F.col("u").isin(self.hot))), "u", "left_semi"))

    def all(self) -> DataFrame:
        return self.ties if self.loud is None else self.ties.unionByName(self.loud)


def label_propagation(vertices: DataFrame, edges: DataFrame, node: str = "user_id",
                      max_rounds: int | None = None, hot: HotKeys = DEFAULT_HOT,
                      trace: list[tuple[int, int]] | None = None) -> DataFrame:
    """Synchronous label propagation until the labels settle: ``node, community, settled``,
    a row per distinct node.

    Each node takes the label most frequent among its neighbours, ties to the
    smallest label; isolated nodes keep their own.  ``min(struct(-count,
    label))`` picks the winner as one algebraic aggregate per node.

    Delta iteration: after the first round only nodes with a neighbour whose label has
    changed vote again (any other node would count the same votes), so what a round
    shuffles follows the changed set: the changed ids, the edges of those who hear
    them, and their votes.  The edge table (``_Votes``) and the labels of each round are
    written in hash buckets of the node and are not shuffled.  ``trace`` collects
    (changed nodes, edges of the nodes that voted) per round.

    Synchronous updates may end in a cycle of states instead of one state.  A
    cycle is recognised by a state seen before (its row count and hash sum); a
    node's community is then its smallest label in the cycle and ``settled`` is
    false where its label still changes.  With ``max_rounds`` a run that reaches
    neither by then raises.
    """
    spark = vertices.sparkSession
    store = RoundStore(spark, "label-propagation")
    votes = _Votes(edges, store, hot)
    buckets = votes.buckets
    changed = F.col("old").isNotNull()

    def voters(labels: DataFrame) -> DataFrame:
        """Edges of the nodes that hear a node whose label has just changed."""
        moved = labels.filter(changed).select(F.col("node").alias("u"))
        return votes.of(votes.of(moved).select(F.col("v").alias("u")).distinct())

    def step(labels: DataFrame, heard: DataFrame) -> DataFrame:
        cast = split_join(heard, labels.select(F.col("node").alias("v"), "label"), "v", votes.hot)
        counted = cast.groupBy("u", "label").agg(F.count(F.lit(1)).alias("cnt"))
        best = (counted.groupBy(F.col("u").alias("node"))
                .agg(F.min(F.struct((-F.col("cnt")).alias("neg"), F.col("label").alias("label"))).alias("w"))
                .select("node", F.col("w.label").alias("new")))
        moved = F.col("new") != F.col("label")
        nxt = labels.select("node", "label").join(apart(best), "node", "left").select(
            "node", F.coalesce("new", "label").alias("label"), F.when(moved, F.col("label")).alias("old"))
        return store.put_bucketed(nxt, "labels", "node", buckets)

    def state(labels: DataFrame) -> tuple[tuple, int]:
        row = labels.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "label").cast("decimal(38,0)")),
                         F.count("old")).first()
        return (row[0], row[1]), row[2]

    first = vertices.select(F.col(node).alias("node"), F.col(node).alias("label"), F.lit(None).cast(vertices.schema[node].dataType).alias("old"))
    labels = store.put_bucketed(first.distinct().repartition(buckets, "node"), "labels", "node", buckets)
    seen = {state(labels)[0]: 0}
    heard = votes.all()
    for done in count(1):
        if max_rounds is not None and done > max_rounds:
            raise RuntimeError(f"labels have not settled after {max_rounds} rounds")
        before, labels = heard, step(labels, heard)
        now, moved = state(labels)
        if trace is not None:
            trace.append((moved, before.count()))
        if now in seen:
            break
        seen[now] = done
        heard = voters(labels)
    # one more turn of the cycle (of one state, as a rule): least and greatest label per node
    held = store.put(labels.select("node", F.col("label").alias("lo"), F.col("label").alias("hi")), "cycle")
    for _ in range(done - seen[now] - 1):
        labels = step(labels, voters(labels))
        held = store.put(held.join(apart(labels.select("node", "label")), "node").select(
            "node", F.least("lo", "label").alias("lo"), F.greatest("hi", "label").alias("hi")), "cycle")
    store.drop("ties", "loud", "labels")
    return held.select(F.col("node").alias(node), F.col("lo").alias("community"), (F.col("lo") == F.col("hi")).alias("settled"))


def category_counts(communities: DataFrame, orders: DataFrame, lineitem: DataFrame, part: DataFrame,
                    user_id: str = "user_id", community: str = "component") -> DataFrame:
    """``community, category, n`` of the lines that each community's users ordered.

    Aggregates are pushed below each join (line -> order -> customer ->
    community), so every shuffle carries per-key partial counts, not raw rows.
    """
    lt = (lineitem.select("l_orderkey", "l_partkey")
          .join(apart(part.select("p_partkey", "p_type")), F.col("l_partkey") == F.col("p_partkey"))
          .groupBy("l_orderkey", "p_type").agg(F.count(F.lit(1)).alias("n")))
    ct = (lt.join(apart(orders.select("o_orderkey", "o_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
          .groupBy("o_custkey", "p_type").agg(F.sum("n").alias("n")))
    comm = communities.select(F.col(user_id).alias("uid"), F.col(community).alias("community"))
    return (ct.join(apart(comm), F.col("o_custkey").cast("string") == F.col("uid"))
            .groupBy("community", F.col("p_type").alias("category"))
            .agg(F.sum("n").cast("bigint").alias("n")))


def community_taste(communities: DataFrame, orders: DataFrame, lineitem: DataFrame, part: DataFrame,
                    k: int = 3, user_id: str = "user_id", digits: int = 4) -> DataFrame:
    """Top-k categories per community with share and lift over the global share."""
    return taste_table(category_counts(communities, orders, lineitem, part, user_id), k, digits)


def taste_test(cc: DataFrame, digits: int = 4) -> DataFrame:
    """Do communities prefer the same categories?  One row per community of a
    ``community, category, n`` table (unique pairs, n > 0; a null community is left out):

    ``n, categories`` (that occur in it), ``chi_square`` = sum over all categories of
    (n - expected)^2 / expected, where expected = community total x category total /
    total, and ``js_divergence`` (base 2: 0 = like the whole, 1 = nothing in common)
    of its category shares from the whole's.

    Categories that a community lacks need no row: they add up to
    ``total - observed`` in closed form, so no community x category product is made.
    Both sums are algebraic per community; a community has at most one row per category."""
    from pyspark.sql import Window
    cc = cc.filter(F.col("community").isNotNull())
    whole = cc.groupBy("category").agg(F.sum("n").alias("_category"))
    total = cc.agg(F.sum("n")).scalar().cast("double")
    own = F.sum("n").over(Window.partitionBy("community")).cast("double")
    cells = cc.withColumn("_own", own).join(whole, "category")
    n, c, own = F.col("n").cast("double"), F.col("_category").cast("double"), F.col("_own")
    share, all_ = n / own, c / total
    mid = (share + all_) / F.lit(2.0)
    part = (share * F.log2(share / mid) + all_ * F.log2(all_ / mid)) / F.lit(2.0)
    # absent categories: expected once each, and half their share of the whole
    chi = F.sum(n * n / (own * all_)) - F.max("_own")
    js = F.sum(part) + (F.lit(1.0) - F.sum(all_)) / F.lit(2.0)
    return cells.groupBy("community").agg(
        F.sum("n").cast("bigint").alias("n"), F.count(F.lit(1)).alias("categories"),
        F.round(chi, digits).alias("chi_square"), F.round(F.greatest(js, F.lit(0.0)), digits).alias("js_divergence"))


def taste_association(cc: DataFrame, digits: int = 4) -> DataFrame:
    """The test of the whole table in one row: ``n, communities, categories, chi_square, degrees`` (of
    freedom), ``cramers_v`` (0 = all alike, 1 = each its own; null with one community or
    category) and ``js_divergence``, the communities' divergences weighted by their totals."""
    cc = cc.filter(F.col("community").isNotNull())
    each = taste_test(cc, digits=12)
    row = each.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("communities"), F.sum("chi_square").alias("chi"),
                   F.sum(F.col("n") * F.col("js_divergence")).alias("js"))
    categories = cc.select("category").distinct().agg(F.count(F.lit(1))).scalar()
    row = row.withColumn("categories", categories)
    least = F.least(F.col("communities"), F.col("categories")) - 1
    return row.select(
        "n", "communities", "categories", F.round("chi", digits).alias("chi_square"),
        ((F.col("communities") - 1) * (F.col("categories") - 1)).alias("degrees"),
        F.round(F.sqrt(F.try_divide(F.greatest("chi", F.lit(0.0)), (F.col("n") * least).cast("double"))), digits).alias("cramers_v"),
        F.round(F.try_divide(F.col("js"), F.col("n").cast("double")), digits).alias("js_divergence"))


def taste_table(cc: DataFrame, k: int, digits: int = 4) -> DataFrame:
    """Top-k categories per community from ``community, category, n`` counts.

    The counts are referenced by the shares, both totals and the grand total, so
    they are written once and scanned: the joins behind them run once."""
    cc = RoundStore(cc.sparkSession, "community-taste").put(cc, "counts")
    tot = cc.groupBy("community").agg(F.sum("n").alias("community_total"))
    glob = cc.groupBy("category").agg(F.sum("n").alias("global_n"))
    gtotal = cc.agg(F.sum("n")).scalar()
    scored = (cc.join(apart(tot), "community").join(glob, "category")
              .withColumn("share", F.col("n").cast("double") / F.col("community_total").cast("double"))
              .withColumn("global_share", F.col("global_n").cast("double") / gtotal.cast("double")))
    ranked = top_k_per_group(scored, ["community"], [F.col("n").desc(), F.col("category").asc()], k)
    return ranked.select("community", "category", "n", F.round("share", digits).alias("share"),
                         F.round(F.col("share") / F.col("global_share"), digits).alias("lift"),
                         F.col("rank").cast("int").alias("rank"))
