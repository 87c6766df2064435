"""Conversation prefix trie by a splitter skeleton.

Conversations that begin with the same turns share the nodes of those turns. A
turn is the first 128 bits of a SHA-256 of its role and text, a conversation's
path its turns' digests in a row (16 bytes each), so path order is byte order
and the members of a node are neighbours in it.

1. Paths are made by Spark (one group per conversation; texts are hashed before
   any shuffle and never travel).
2. Splitters are ranks of a hash sample of ``(path, conv_id)``. Their paths form the
   skeleton: a node with members on both sides of a splitter is a prefix of
   it, so every other node lies in one shard whole. The skeleton is
   broadcast; its size is bounded (``MAX_NODES``, by taking fewer splitters).
3. Each shard, sorted by ``(path, conv_id)``, is read once as a stream with a stack of
   the open nodes: nodes outside the skeleton are finished there, skeleton nodes
   give partial aggregates. Copies of one path are split by ``conv_id``, so a
   conversation that a third of all repeat fills no single shard.
4. The partial aggregates are reduced by node, and what only the whole skeleton
   knows (its own children, leaves and savings) is added along it from its leaves up.

The digest of the ids that end in a node is sequential by its definition: for
skeleton nodes the shards join their ids in ascending runs of ``RUN`` and one task
per node hashes the runs as a stream.

Memory: a shard's task holds the stack, the finished children of open nodes, and one
Arrow batch; a conversation is one row of 20 bytes a turn.

Defined results: rows without a conv_id are left out; a null role or text is empty; turns
with equal numbers follow their digests, repeated rows stay; a conversation whose
base is absent begins with its own later turns; ``conv_id % 100`` has the sign of
conv_id; an empty table has no node; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.llm.common import mapped, written

#: Bytes of a turn's digest.
WIDTH = 16
#: Conversations branch off those whose id ends in zeros here, after up to HEADS - 1 turns.
BASE, HEADS = 100, 6
#: Turns in one shard, about; bounds on shards and on nodes of the broadcast skeleton.
SHARD_TURNS, MIN_SHARDS, MAX_SHARDS, MAX_NODES = 1_000_000, 12, 16_384, 200_000
#: Sampled paths per splitter.
SAMPLES = 16
#: Ids joined in one run of a skeleton node's ends.
RUN = 4096

NO_ENDS = hashlib.sha256(b"").hexdigest()


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return (conversations.filter(F.col("conv_id").isNotNull())
            .select(F.col("conv_id").cast("long").alias("conv_id"), "turn",
                    F.substring(digest, 1, 2 * WIDTH).alias("key"), F.length(text).alias("chars"),
                    role.alias("role"), text.alias("text")))


def _base(conv_id: Column) -> Column:
    return conv_id - conv_id % BASE


def _taken(conv_id: Column) -> Column:
    """How many turns of its base a conversation starts with, at most."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """``conv_id, path, chars``: each rebuilt conversation's turn digests in a row, and the
    code points of its turns' texts."""
    own = (_turns(conversations).groupBy("conv_id")
           .agg(F.sort_array(F.collect_list(F.struct("turn", "key", "chars"))).alias("own")))
    heads = own.filter(F.col("conv_id") % BASE == 0).select(
        F.col("conv_id").alias("_base"), F.slice("own", 1, HEADS - 1).alias("head"))
    h = _taken(F.col("conv_id"))
    turns = F.concat(F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), h),
                     F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0))))
    joined = own.join(heads, _base(F.col("conv_id")) == F.col("_base"), "left").select("conv_id", turns.alias("turns"))
    return joined.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), "")).alias("path"),
                         F.transform("turns", lambda t: t["chars"]).alias("chars"))


@dataclass
class Skeleton:
    """The trie of the splitters' paths; node 0 is the root."""

    splitters: list[tuple[bytes, int]] = field(default_factory=list)
    ids: dict[bytes, int] = field(default_factory=lambda: {b"": 0})
    parents: list[int] = field(default_factory=lambda: [-1])
    depths: list[int] = field(default_factory=lambda: [0])
    chars: list[int] = field(default_factory=lambda: [0])

    def add(self, path: bytes, conv_id: int, chars: list[int]) -> None:
        self.splitters.append((path, conv_id))
        node = 0
        for d in range(1, len(path) // WIDTH + 1):
            own = self.ids.setdefault(path[:d * WIDTH], len(self.parents))
            if own == len(self.parents):
                self.parents.append(node)
                self.depths.append(d)
                self.chars.append(chars[d - 1])
            node = own


def skeleton_of(sample: list[tuple[bytes, int, list[int]]], shards: int, most: int = MAX_NODES) -> Skeleton:
    """The skeleton of at most ``shards - 1`` splitters at even ranks of ``sample``, and of fewer
    where their paths have more than ``most`` nodes. Any splitters give right results."""
    sample = sorted(sample, key=lambda s: s[:2])
    while True:
        ranks = sorted({len(sample) * i // shards for i in range(1, shards)} - {0})
        out = Skeleton()
        for rank in ranks:
            out.add(*sample[rank])
            if len(out.parents) > most:
                break
        if len(out.parents) <= most:
            return out
        shards = max(1, shards // 2)


def skeleton(paths: DataFrame, shard_turns: int = SHARD_TURNS, min_shards: int = MIN_SHARDS,
             most: int = MAX_NODES) -> Skeleton:
    """Splitters from a sample by a hash of the id, about ``SAMPLES`` paths a splitter."""
    total = paths.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("chars")).alias("turns")).first()
    if not total["n"]:
        return Skeleton()
    shards = max(min_shards, min(MAX_SHARDS, -(-(total["turns"] or 0) // shard_turns)))
    # paths that average many turns are sampled less
    wanted = min(shards * SAMPLES, max(shards, most * SAMPLES * total["n"] // max(1, total["turns"] or 0)))
    share = min(1 << 30, (wanted << 30) // total["n"] + 1)
    rows = paths.filter(F.pmod(F.xxhash64("conv_id", F.lit(12)), F.lit(1 << 30)) < share)
    return skeleton_of([(bytes(r.path), r.conv_id, r.chars) for r in rows.collect()], shards, most)


#: kind 0: a finished node; 1: a part of a skeleton node; 2: a run of ids that end in a skeleton node.
LOCAL = ("kind int, conv_id long, depth int, parent_conv_id long, skeleton int, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, ends string")


class _Open:
    """A node whose members are still being read."""

    __slots__ = ("chars", "children", "conv_id", "done", "ends", "leaves", "n", "saved", "skeleton")

    def __init__(self, skeleton: int | None, chars: int):
        self.skeleton, self.chars = skeleton, chars
        self.n = self.children = self.leaves = self.saved = 0
        self.conv_id: int | None = None
        self.ends = None  # a running digest, or the held ids of a skeleton node
        self.done: list[list] = []  # finished children that wait for this node's conv_id


class LocalTrie:
    """Finishes the nodes of sorted shards; ``rows`` fills with tuples of ``LOCAL``."""

    def __init__(self, ids: dict[bytes, int]):
        self.ids = ids
        self.rows: list[tuple] = []
        self.stack: list[_Open] = []
        self.path = b""

    def _run(self, node: _Open) -> None:
        self.rows.append((2, node.ends[0], None, None, node.skeleton, None, None, None, None, ",".join(map(str, node.ends))))
        node.ends = None

    def _close(self) -> None:
        depth = len(self.stack) - 1
        node = self.stack.pop()
        for child in node.done:
            child[3] = node.conv_id
            self.rows.append(tuple(child))
        above = self.stack[-1] if self.stack else None
        if above is not None:
            above.n += node.n
            above.conv_id = node.conv_id if above.conv_id is None else min(above.conv_id, node.conv_id)
        if node.skeleton is not None:
            if node.ends:
                self._run(node)
            self.rows.append((1, node.conv_id, depth, None, node.skeleton, node.n, node.children, node.leaves, node.saved, None))
            return
        leaves = node.leaves or 1
        saved = node.saved + (node.n - 1) * node.chars
        ends = node.ends.hexdigest() if node.ends else NO_ENDS
        row = [0, node.conv_id, depth, None, above.skeleton, node.n, node.children, leaves, saved, ends]
        above.children += 1
        above.leaves += leaves
        above.saved += saved
        if above.skeleton is None:
            above.done.append(row)
        else:
            self.rows.append(tuple(row))

    def shard(self) -> None:
        """Closes what is open: the next row is of another shard."""
        while self.stack:
            self._close()
        self.path = b""

    def add(self, conv_id: int, path: bytes, chars: list[int]) -> None:
        depth = len(path) // WIDTH
        if not self.stack:
            self.stack.append(_Open(0, 0))
        same = 0
        while (same < depth and same < len(self.stack) - 1
               and path[same * WIDTH:(same + 1) * WIDTH] == self.path[same * WIDTH:(same + 1) * WIDTH]):
            same += 1
        while len(self.stack) - 1 > same:
            self._close()
        for d in range(same, depth):
            known = self.stack[-1].skeleton is not None
            self.stack.append(_Open(self.ids.get(path[:(d + 1) * WIDTH]) if known else None, chars[d]))
        self.path = path
        node = self.stack[-1]
        node.n += 1
        node.conv_id = conv_id if node.conv_id is None else min(node.conv_id, conv_id)
        if node.skeleton is not None:
            node.ends = node.ends or []
            node.ends.append(conv_id)
            if len(node.ends) >= RUN:
                self._run(node)
        elif node.ends is None:
            node.ends = hashlib.sha256(str(conv_id).encode())
        else:
            node.ends.update(f",{conv_id}".encode())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string()]
    names = [part.split()[0] for part in LOCAL.split(", ")]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def local_nodes(paths: DataFrame, frame: Skeleton) -> DataFrame:
    """The shards' finished nodes, parts of skeleton nodes and runs of their ends (``LOCAL``)."""
    shared = paths.sparkSession.sparkContext.broadcast((frame.splitters, frame.ids))
    shards = len(frame.splitters) + 1

    def numbered(batch: pa.RecordBatch) -> pa.RecordBatch:
        splitters = shared.value[0]
        keys = zip(batch["path"].to_pylist(), batch["conv_id"].to_pylist(), strict=True)
        return batch.append_column("shard", pa.array([bisect_right(splitters, k) for k in keys], pa.int32()))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, at = LocalTrie(shared.value[1]), None
        for batch in batches:
            for shard, conv_id, path, chars in zip(*(batch[c].to_pylist() for c in ("shard", "conv_id", "path", "chars")),
                                                   strict=True):
                if shard != at:
                    trie.shard()
                    at = shard
                trie.add(conv_id, path, chars)
                if len(trie.rows) >= 10_000:
                    yield _batch(trie.rows)
                    trie.rows = []
        trie.shard()
        if trie.rows:
            yield _batch(trie.rows)

    sharded = mapped(paths.select("conv_id", "path", "chars"), numbered, "conv_id long, path binary, chars array<int>, shard int")
    sharded = sharded.repartitionById(shards, "shard").sortWithinPartitions("shard", "path", "conv_id")
    return sharded.mapInArrow(finish, LOCAL)


def _ends(nodes: DataFrame) -> DataFrame:
    """``skeleton, ends``: the digest of all ids that end in a skeleton node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            for node, ids in zip(batch["skeleton"].to_pylist(), batch["ends"].to_pylist(), strict=True):
                if node == at:
                    digest.update(b"," + ids.encode())
                    continue
                if digest:
                    yield pa.record_batch([pa.array([at], pa.int32()), pa.array([digest.hexdigest()])], ["skeleton", "ends"])
                at, digest = node, hashlib.sha256(ids.encode())
        if digest:
            yield pa.record_batch([pa.array([at], pa.int32()), pa.array([digest.hexdigest()])], ["skeleton", "ends"])

    runs = nodes.filter("kind = 2").select("skeleton", "conv_id", "ends")
    return (runs.repartition("skeleton").sortWithinPartitions("skeleton", "conv_id")
            .select("skeleton", "ends").mapInArrow(run, "skeleton int, ends string"))


def summed(frame: Skeleton, parts: list[tuple]) -> list[tuple]:
    """Rows of the skeleton's nodes from their reduced parts (skeleton, n_convs, conv_id,
    children, leaves and savings outside the skeleton), added from the deepest up."""
    at = {p[0]: list(p) for p in parts}
    own = [0] * len(frame.parents)
    for node in at:
        if node:
            own[frame.parents[node]] += 1
    out = []
    for node in sorted(at, key=lambda k: -frame.depths[k]):
        _, n, conv_id, children, leaves, saved = at[node]
        children += own[node]
        leaves = leaves if children else 1
        saved += (n - 1) * frame.chars[node]
        above = at.get(frame.parents[node])
        if above:
            above[4] += leaves
            above[5] += saved
        out.append((node, conv_id, frame.depths[node], above and above[2], n, children, leaves, saved))
    return out


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, min_shards: int = MIN_SHARDS,
         most: int = MAX_NODES) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations: ``conv_id`` (smallest member), ``depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    spark = conversations.sparkSession
    paths = written(spark, rebuilt_paths(conversations), "trie-paths")
    frame = skeleton(paths, shard_turns, min_shards, most)
    nodes = written(spark, local_nodes(paths, frame), "trie-nodes")
    parts = (nodes.filter("kind = 1").groupBy("skeleton")
             .agg(*(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.min("conv_id").alias("conv_id"))
             .select("skeleton", "n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens"))
    # at most MAX_NODES rows
    top = spark.createDataFrame(summed(frame, [tuple(r) for r in parts.collect()]),
                                "skeleton int, conv_id long, depth int, parent_conv_id long, n_convs long, "
                                "n_children long, n_leaves long, saved_tokens long")
    none = F.lit(NO_ENDS)
    upper = (top.join(_ends(nodes), "skeleton", "left").withColumn("ends_sha256", F.coalesce("ends", none)))
    above = F.broadcast(top.select("skeleton", F.col("conv_id").alias("_above")))
    lower = (nodes.filter("kind = 0").join(above, "skeleton", "left")
             .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above")).withColumnRenamed("ends", "ends_sha256"))
    return upper.select(*NODE).unionByName(lower.select(*NODE)).withColumn("depth", F.col("depth").cast("long"))


def last_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` (by ``conv_id, depth``) with the ``role`` and ``text`` of their last turn; the
    root has none."""
    place = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    turns = _turns(conversations).withColumn("at", F.row_number().over(place))
    sizes = turns.groupBy("conv_id").agg(F.max("at").alias("size"))
    conv = F.col("conv_id")
    bases = sizes.select(F.col("conv_id").alias("_base"), F.col("size").alias("_size")).filter(F.col("_base") % BASE == 0)
    head = F.least(_taken(conv), F.coalesce("_size", F.lit(0)))
    of = nodes.join(bases, _base(conv) == F.col("_base"), "left")
    own = F.col("depth") > head
    of = of.withColumns({"_from": F.when(own, conv).otherwise(_base(conv)),
                         "_at": F.when(own, F.col("depth") - head + _taken(conv)).otherwise(F.col("depth"))})
    texts = turns.select(F.col("conv_id").alias("_from"), F.col("at").cast("long").alias("_at"), "role", "text")
    return of.join(texts, ["_from", "_at"], "left").select(*nodes.columns, "role", "text")


def oracle() -> str:
    """DuckDB: every prefix of every rebuilt conversation, grouped."""
    return rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS l
      FROM t GROUP BY conv_id),
h AS (SELECT conv_id, l, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
        lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
          lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % {HEADS} AS h FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(b.l[1:h], []), h.l[h + 1:]) AS p
      FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % {BASE}),
m AS (SELECT conv_id, d, p[1:d] AS pre, len(p) AS size FROM r, unnest(range(0, len(p) + 1)) AS u(d)),
n AS (SELECT d, pre, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE length(pre[d].text) END AS chars,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = size), '')) AS ends FROM m GROUP BY d, pre),
v AS (SELECT m.conv_id AS member, m.d, n.conv_id AS node FROM m JOIN n ON m.d = n.d AND m.pre = n.pre),
c AS (SELECT n.*, v.node AS parent FROM n LEFT JOIN v ON v.member = n.conv_id AND v.d = n.d - 1),
k AS (SELECT parent, d - 1 AS d, count(*) AS children FROM c WHERE d > 0 GROUP BY parent, d),
e AS (SELECT c.*, coalesce(k.children, 0) AS children FROM c LEFT JOIN k ON k.parent = c.conv_id AND k.d = c.d),
s AS (SELECT v.node, v.d, sum(CASE WHEN e.children = 0 THEN 1 ELSE 0 END) AS leaves, sum((e.n_convs - 1) * e.chars) AS saved
      FROM e JOIN v ON v.member = e.conv_id AND v.d <= e.d GROUP BY v.node, v.d)
SELECT e.conv_id, CAST(e.d AS BIGINT) AS depth, e.parent AS parent_conv_id, CAST(e.n_convs AS BIGINT) AS n_convs,
  CAST(e.children AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens,
  e.ends AS ends_sha256
FROM e JOIN s ON s.node = e.conv_id AND s.d = e.d"""
