"""N-gram Jaccard join: documents whose sets of word n-grams overlap by at least
``percent`` of their union, as a blocked sparse product of the document by n-gram
incidence matrix.

Rows of the matrix are distinct n-gram sets (exact copies share a row), columns
are 64-bit n-gram hashes in one global order: rare first, n-grams that occur in
very many documents last, hash order otherwise. Any order is correct; this one
keeps common passages out of the products. For a row of n n-grams only the first
``n - ceil(percent * n / 100) + 1`` columns (its prefix) can be the first match of
a linking pair, and sizes must be within ``percent``.

1. One scan hashes whole texts: set size, set signature, prefix columns.
2. Product over the prefix columns, a block per column; columns of one row are
   dropped. First, in ``ROUNDS`` passes, every row meets one row only: the least
   of its blocks' pivots (a pivot is one row of a block). So a pass has at most
   as many pairs as rows, however large the blocks; what links is contracted.
3. Rows of blocks of more than ``SMALL_BLOCK`` rows that still hold several
   components then go to one tile each, of their largest such block (``TILE_ROUNDS``
   times): all with a sketch of the set, then those with a plausible partner with
   their whole sets. A tile has at most ``TILE_BYTES`` of sets; inside, overlap counts
   decide all its pairs, and only a spanning forest of the links comes out, so a
   group of k near copies gives fewer than k rows, not k * k pairs.
4. What no tile has decided is multiplied out: small blocks pair by pair, larger
   ones in tiles of at most about ``TILE`` rows a side, where overlap counts of row
   pairs are accumulated over the prefix columns and pairs below the
   size-derived bound are discarded; a pair comes from the block of its least
   shared column only.
5. Pairs are verified on their whole sets, exactly; component ids are the
   smallest document ids.

Sets of fewer than ``percent / (100 - percent)`` n-grams cannot link with a
different set, and need no product.

Defined results: null, empty or wordless texts have an empty set and link with
nothing; fewer words than ``size`` make one n-gram of all of them; rows with a
null id take part, a component of only such rows has a null id; repeated rows
are judged by their texts; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.llm.common import SEPARATORS, fresh, give_back, mixed, on_batches, texts, window_hashes, word_hashes
from ratelens.llm.encoding import encoder
from ratelens.operators.graph import connected_components
from ratelens.operators.skew import HotKeys, hot_keys, split_join
from ratelens.session import RoundStore

SIZE, PERCENT = 4, 85
TILE = 1024
#: Rows of a block whose pairs are taken directly, at most.
SMALL_BLOCK = 8
#: Passes in which rows of larger blocks go to a tile with their sets; bytes of sets and rows in a tile, about.
TILE_ROUNDS, TILE_BYTES, TILE_ROWS = 2, 16 << 20, 4096
#: N-grams moved to the end of the order: bounds the broadcast list (8 bytes each).
COMMON = 200_000
#: Passes in which each row meets one pivot.
ROUNDS = 2
#: Bytes of row names (signature, id, text hash: 24 a row) broadcast at most to pick texts; beyond, a shuffled join.
BROADCAST_BYTES = 24 << 20


def _lean(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``step`` in a Python worker that first gives back what earlier tasks left (a tokenizer with
    its words, freed memory), and at the end what this one leaves: workers outlive their tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()
        give_back()
        yield from step(batches)
        give_back()
    return run


def mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` on every Arrow batch, in a lean worker."""
    return df.mapInArrow(_lean(on_batches(fn)), schema)


def ngrams(text: bytes, size: int = SIZE) -> np.ndarray:
    """Sorted distinct n-gram hashes of a text (A-Z in lower case)."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    if len(h) < size:
        # one n-gram of all words, unlike any n-gram of size words
        return mixed(window_hashes(h, len(h)) + np.uint64(len(h)))
    return np.unique(mixed(window_hashes(h, size)))


def least_overlap(n: np.ndarray | int, percent: int = PERCENT):
    """The least overlap of a set of ``n`` with any set it links with."""
    return -(-n * percent // 100)


def _frequent(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of at least 1/3000 of the sets ``held`` (three), and in how many they are; the list is
    emptied. Sorted in place: a task holds the portion twice at most."""
    least = max(3, math.ceil(len(held) / 3000))
    keys = np.concatenate(held)
    held.clear()
    keys.sort()
    # the first of a run of at least so many equal keys
    last = max(0, len(keys) - least + 1)
    first = keys[least - 1:] == keys[:last]
    first[1:] &= keys[1:last] != keys[:max(0, last - 1)]
    often = keys[:last][first]
    return often, np.searchsorted(keys, often, "right") - np.searchsorted(keys, often, "left")


def _common(docs: DataFrame, size: int, limit: int) -> np.ndarray:
    """The n-grams that most documents hold, by lossy counting: every task counts
    its documents in portions and passes on n-grams of at least 1/3000 of a
    portion (three documents); the sums over all tasks are ranked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            keys, counts = _frequent(held)
            return pa.record_batch([pa.array(keys.view(np.int64)), pa.array(counts)], ["g", "n"])

        for batch in batches:
            for text in texts(batch["text"]):
                own = ngrams(text, size)
                if len(own):
                    held.append(own)
                    n += len(own)
                if n >= 1 << 22:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    counted = docs.select("text").mapInArrow(_lean(run), "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.col("n").desc(), "g").limit(limit).orderBy("n", "g")
    # rarest of the common first: position = rank in the order's tail
    return np.array([r.g for r in top.select("g").collect()], np.int64).view(np.uint64)


def _columns(own: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A set as ascending column numbers in the global order: n-grams not in
    ``common`` by 63 bits of their hash, then the common ones by their rank."""
    columns = own >> np.uint64(1)
    if len(common):
        at = np.searchsorted(common, own)
        at[at == len(common)] = 0
        late = common[at] == own
        columns[late] = np.uint64(1 << 63) + rank[at[late]].astype(np.uint64)
        columns.sort()
    return columns


def _signature(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def _text_hash(name: str = "th") -> Column:
    """With the id it names a row: an id may be repeated or missing."""
    return F.xxhash64("text").alias(name)


def incidence(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, common: int = COMMON) -> DataFrame:
    """``doc_id, th, n, sig, prefix, sketch`` per row of ``docs``: a hash of the text, set size,
    64 bits of the set's signature, the prefix columns in the global order, and ``sketch_of``."""
    spark = docs.sparkSession
    by_rank = _common(docs, size, common)
    order = np.argsort(by_rank)
    tail = spark.sparkContext.broadcast((by_rank[order], order))
    smallest = math.ceil(percent / max(1, 100 - percent))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, sigs, prefixes, sketches = [], [], [], []
        for text in texts(batch["text"]):
            own = ngrams(text, size)
            n.append(len(own))
            sigs.append(_signature(own))
            cut = len(own) - least_overlap(len(own), percent) + 1 if len(own) >= smallest else 0
            prefixes.append(_columns(own, *tail.value)[:cut].view(np.int64))
            sketches.append(sketch_of(own) if cut else b"")
        offsets = np.cumsum([0] + [len(p) for p in prefixes])
        return pa.record_batch([batch["doc_id"].cast(pa.int64()), batch["th"], pa.array(n, pa.int64()), pa.array(sigs, pa.int64()),
                                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(prefixes))),
                                pa.array(sketches, pa.binary())], ["doc_id", "th", "n", "sig", "prefix", "sketch"])

    return mapped(docs.select("doc_id", "text", _text_hash()), run,
                  "doc_id long, th long, n long, sig long, prefix array<long>, sketch binary")


#: Parts of a sketch.
PARTS = 256


def sketch_of(own: np.ndarray) -> bytes:
    """How many n-grams of a set fall into each of ``PARTS`` equal parts of the hash range, a byte
    each; empty where a count does not fit. Two sets share at most the sum of the lesser
    counts, which rules out most pairs that only share a passage."""
    counts = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=PARTS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _sketches(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sketches as rows of a matrix, and which of them are known."""
    known = np.array([len(v) == PARTS for v in values], bool)
    return np.frombuffer(b"".join(v if len(v) == PARTS else bytes(PARTS) for v in values), np.uint8).reshape(-1, PARTS), known


def sketches_allow(a: np.ndarray, b: np.ndarray, known: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` n-grams may link by their sketches, row by row (``b`` may be one row)."""
    most = np.minimum(a, b).sum(axis=-1, dtype=np.int64)
    return ~known | (most >= _least_shared(n, m, percent))


def _least_shared(n, m, percent: int):
    """The least overlap of linking sets of ``n`` and ``m`` n-grams."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_allows(x: np.ndarray, y: np.ndarray, n: int, m: int, percent: int = PERCENT) -> bool:
    """Whether sets of ``n`` and ``m`` n-grams with prefixes ``x`` and ``y`` may link:
    what they share up to the earlier prefix's end is in both prefixes, the rest
    is at most what that set has left."""
    if 100 * min(n, m) < percent * max(n, m) or not len(x) or not len(y):
        return False
    left = n - len(x) if x[-1] <= y[-1] else m - len(y)
    return len(np.intersect1d(x, y, assume_unique=True)) + left >= _least_shared(n, m, percent)


def _lists(values: pa.Array) -> list[np.ndarray]:
    """The rows of an Arrow column of long lists."""
    flat = values.values.to_numpy(zero_copy_only=False)
    offsets = values.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _sets(needed: DataFrame, rows: DataFrame, docs: DataFrame, size: int, store: RoundStore, tag: str) -> DataFrame:
    """``sig, s``: the whole sets (as bytes) of the signatures ``needed``, made from one text each."""
    of = store.put(rows.select("sig", F.col("doc_id").alias("_id"), F.col("th").alias("_th")).join(needed, "sig", "left_semi"), "needed", keep=1)
    if 24 * of.count() <= BROADCAST_BYTES:  # the texts then stay where they are
        of = F.broadcast(of)

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [ngrams(t, size) for t in texts(batch["text"])]
        # texts of one id and one hash may still differ
        asked = pa.array([_signature(x) == s for x, s in zip(found, batch["sig"].to_pylist(), strict=True)], pa.bool_())
        return pa.record_batch([batch["sig"], pa.array([x.tobytes() for x in found], pa.binary())],
                               ["sig", "s"]).filter(asked)

    named = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    found = docs.select("doc_id", "text", _text_hash()).join(of, named).select("sig", "text")
    whole = store.put(mapped(found, sets, "sig long, s binary"), tag, keep=2)
    # rows may repeat an id and its text; without such rows the sets need no shuffle to be one each
    if whole.count() > whole.agg(F.countDistinct("sig")).first()[0]:
        whole = store.put(whole.dropDuplicates(["sig"]), tag, keep=1)
    return whole


def _verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, size: int, percent: int, store: RoundStore) -> DataFrame:
    """Those of ``pairs`` (a, b: signatures) that link: first by their sketches and prefixes, then
    exactly, on the whole sets made from their texts again."""
    def side(x: str, *columns: str) -> DataFrame:
        return rows.select(F.col("sig").alias(x), *(F.col(c).alias(x + c) for c in columns))

    def by_sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        (a, ka), (b, kb) = (_sketches(batch[c].to_pylist()) for c in ("asketch", "bsketch"))
        ok = sketches_allow(a, b, ka & kb, batch["an"].to_numpy(), batch["bn"].to_numpy(), percent)
        return batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def by_prefix(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [prefix_allows(x, y, n, m, percent) for x, y, n, m in zip(
            *([x.view(np.uint64) for x in _lists(batch[c])] for c in ("aprefix", "bprefix")), batch["an"].to_pylist(), batch["bn"].to_pylist(), strict=True)]
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    some = pairs.join(side("a", "n", "sketch"), "a").join(side("b", "n", "sketch"), "b")
    some = store.put(mapped(some.select("a", "b", "an", "bn", "asketch", "bsketch"), by_sketch, "a long, b long"), "sketched", keep=1)
    some = some.join(side("a", "n", "prefix"), "a").join(side("b", "n", "prefix"), "b")
    left = store.put(mapped(some.select("a", "b", "an", "bn", "aprefix", "bprefix"), by_prefix, "a long, b long"), "bounded", keep=1)
    needed = left.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    whole = _sets(needed, rows, docs, size, store, "sets")

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch["x"], batch["y"], strict=True):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = (left.join(whole.select(F.col("sig").alias("a"), F.col("s").alias("x")), "a")
              .join(whole.select(F.col("sig").alias("b"), F.col("s").alias("y")), "b").select("a", "b", "x", "y"))
    links = store.put(mapped(joined, compare, "a long, b long"), "links", keep=99)
    store.drop("sketched", "bounded", "needed", "sets")
    return links


# -- tiles of whole sets --------------------------------------------------------------

def _numbered(sets: list[np.ndarray], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of all sets, set by set, as numbers in the order of their hashes; the rows that hold them,
    n-gram by n-gram; where each n-gram's rows begin (and the last end). One sort, in 32 bits afterwards."""
    keys = np.concatenate(sets)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.append(True, keys[1:] != keys[:-1])
    del keys
    flat = np.empty(len(order), np.int32)
    flat[order] = np.cumsum(starts, dtype=np.int32) - np.int32(1)
    holders = np.repeat(np.arange(len(sets), dtype=np.int32), size)[order]
    return flat, holders, np.append(np.flatnonzero(starts), len(order))


def spanning_links(sets: list[np.ndarray], root: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (of row numbers) that connect what all linking pairs of ``sets`` connect: at
    most a row less than there are rows. Rows of equal ``root`` are connected already.

    Breadth first: a row's overlaps with all rows are counted at once over the incidence
    of its n-grams, and rows reached are not compared again."""
    size = np.array([len(x) for x in sets])
    start = np.cumsum(size) - size
    flat, holders, first = _numbered(sets, size)
    by_root = np.argsort(root, kind="stable")
    names, at, many = np.unique(root[by_root], return_index=True, return_counts=True)
    group = np.searchsorted(names, root)
    new = np.ones(len(sets), bool)
    links, left = [], len(sets)

    def reach(rows: np.ndarray, queue: list[int]) -> int:
        """Marks the rows and all that share a root with them."""
        for g in np.unique(group[rows]):
            own = by_root[at[g]:at[g] + many[g]]
            own = own[new[own]]
            new[own] = False
            queue.extend(own.tolist())
        return int(new.sum())

    for k in range(len(sets)):
        if not new[k]:
            continue
        queue: list[int] = []
        left = reach(np.array([k]), queue)
        while queue and left:
            a = queue.pop()
            mine = flat[start[a]:start[a] + size[a]]
            lo, hi = first[mine], first[mine + 1]
            both = np.bincount(np.concatenate([holders[i:j] for i, j in zip(lo, hi, strict=True)]), minlength=len(sets))
            found = np.flatnonzero(new & (100 * both >= percent * (size[a] + size - both)))
            if len(found):
                # one link to each component reached
                for b in found[np.unique(group[found], return_index=True)[1]]:
                    links.append((a, int(b)))
                left = reach(found, queue)
        if not left:
            break
    return links


def _tile_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """``spanning_links`` of each tile of a stream sorted by tile."""
    held, at = [], None

    def done() -> pa.RecordBatch:
        sig = [r[0] for r in held]
        links = spanning_links([np.frombuffer(r[2], np.uint64) for r in held], np.array([r[1] for r in held]), percent)
        ends = [sorted((sig[a], sig[b])) for a, b in links]
        return pa.record_batch([pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        for tile, *row in zip(*(batch[c].to_pylist() for c in ("tile", "sig", "root", "s")), strict=True):
            if tile != at:
                if len(held) > 1:
                    yield done()
                held, at = [], tile
            held.append(row)
    if len(held) > 1:
        yield done()


def _plausible(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of a stream of rows sorted by tile, ``sig, tile, root`` of those that may link with a row of
    their tile and another root, by sizes and sketches."""
    held, at = [], None

    def done() -> pa.RecordBatch:
        sig, root, n = (np.array([r[k] for r in held], np.int64) for k in (0, 1, 2))
        sketch, known = _sketches([r[3] for r in held])
        order = np.argsort(n, kind="stable")
        sig, root, n, sketch, known = sig[order], root[order], n[order], sketch[order], known[order]
        ok = np.zeros(len(n), bool)
        # sizes within reach are neighbours in the order of sizes
        reach = np.searchsorted(percent * n, 100 * n, "right")
        for i in range(len(n) - 1):
            j = np.arange(i + 1, reach[i])
            j = j[root[j] != root[i]]
            if len(j):
                j = j[sketches_allow(sketch[j], sketch[i], known[j] & known[i], n[j], n[i], percent)]
                ok[j] = True
                ok[i] |= len(j) > 0
        return pa.record_batch([pa.array(sig[ok]), pa.array(np.full(int(ok.sum()), at, np.int64)), pa.array(root[ok])], ["sig", "tile", "root"])

    for batch in batches:
        for tile, *row in zip(*(batch[c].to_pylist() for c in ("tile", "sig", "root", "n", "sketch")), strict=True):
            if tile != at:
                if len(held) > 1:
                    yield done()
                held, at = [], tile
            held.append(row)
    if len(held) > 1:
        yield done()


def _tiled(open_: DataFrame, rows: DataFrame, docs: DataFrame, k: int, size: int, percent: int,
           store: RoundStore) -> tuple[DataFrame, DataFrame]:
    """Links of one pass of tiles, and ``sig, tile``: the rows whose pairs in a tile are decided."""
    best = (open_.filter(F.col("m") > SMALL_BLOCK).groupBy("sig", "n", "root")
            .agg(F.max(F.struct("m", F.xxhash64("c", F.lit(k)).alias("h"), "c")).alias("b"))
            .select("sig", "n", "root", F.col("b.c").alias("c")))
    best = store.put(best, "best", keep=1)
    per = (best.groupBy("c").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_rows"), F.min("root").alias("_a"), F.max("root").alias("_z"))
           .filter("_a <> _z"))
    parts = F.greatest(F.ceil(F.col("_n") * 8 / TILE_BYTES), F.ceil(F.col("_rows") / TILE_ROWS)).cast("long")
    sub = F.pmod(F.xxhash64("sig", F.lit(k)), parts)
    tiles = best.join(per, "c").select("sig", "n", "root", F.xxhash64("c", sub, F.lit(k)).alias("tile"))
    tiles = store.put(tiles, f"tiled{k}", keep=1)
    # rows by their sketches first: few of those that share a passage go on with their sets
    light = tiles.join(rows.select("sig", "sketch"), "sig").select("tile", "sig", "root", "n", "sketch")
    light = light.repartition("tile").sortWithinPartitions("tile")
    few = store.put(light.mapInArrow(_lean(lambda it: _plausible(it, percent)), "sig long, tile long, root long"), "plausible", keep=1)
    whole = _sets(few.select("sig"), rows, docs, size, store, "tile-sets")
    sorted_ = few.join(whole, "sig").select("tile", "sig", "root", "s").repartition("tile").sortWithinPartitions("tile")
    links = store.put(sorted_.mapInArrow(_lean(lambda it: _tile_links(it, percent)), "a long, b long"), "links", keep=99)
    store.drop("best", "plausible", "needed", "tile-sets")
    return links, tiles.select("sig", "tile")


# -- tiles of prefix columns ----------------------------------------------------------

#: Tiles up to this many rows are multiplied together, row pair by row pair.
SMALL_TILE = 64


def _allowed(n, m, lengths, lengths_m, last, last_m, counts, percent: int):
    """Whether rows whose prefixes share ``counts`` columns may reach the least overlap:
    what they share up to the earlier prefix's end is in both prefixes, the rest
    is at most what that row has left."""
    left = np.where(last <= last_m, n - lengths, m - lengths_m)
    return counts + left >= _least_shared(n, m, percent)


def pair_counts(flat: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple:
    """Overlap counts of many pairs of rows and their least shared number (-1: none);
    row k has the distinct numbers ``flat[start[k]:start[k] + size[k]]``, below 2**31."""
    out, first = np.zeros(len(a), np.int64), np.full(len(a), -1, np.int64)
    for lo in range(0, len(a), 16384):
        keys = []
        for side in (a[lo:lo + 16384], b[lo:lo + 16384]):
            n = size[side]
            pair = np.repeat(np.arange(len(side), dtype=np.int64), n)
            at = np.arange(n.sum()) + np.repeat(start[side] - np.cumsum(n) + n, n)
            keys.append(pair << 31 | flat[at])
        both = np.sort(np.concatenate(keys))
        twice = both[1:][both[1:] == both[:-1]]
        pair = twice >> 31
        out[lo:lo + 16384] = np.bincount(pair, minlength=len(a[lo:lo + 16384]))
        new = np.append(True, pair[1:] != pair[:-1])[:len(pair)]
        first[lo + pair[new]] = twice[new] & ((1 << 31) - 1)
    return out, first


def tile_pairs(tile: np.ndarray, cross: np.ndarray, column: np.ndarray, sig: np.ndarray, n: np.ndarray,
               root: np.ndarray, side: np.ndarray, last: np.ndarray, columns: list[np.ndarray],
               percent: int = PERCENT, decided: list[np.ndarray] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of the same ``tile`` (rows sorted by it) that may link: rows of
    different components and near sizes, whose overlap count over the prefix
    columns reaches the size-derived bound. In a ``cross`` tile, of two halves of a
    block, only rows of different ``side`` pair. ``columns``: a row's prefix columns
    in open blocks (rows of different components share no others); ``last``: its
    last prefix column. Pairs of rows with an equal number in one of ``decided`` (0: none) are
    left out. A pair comes from the block of its least shared column only."""
    size = np.array([len(x) for x in columns])
    start = np.cumsum(size) - size
    names, flat = np.unique(np.concatenate(columns), return_inverse=True)
    block = np.searchsorted(names, column)
    lengths = n - least_overlap(n, percent) + 1
    found = []

    def may_pair(a, b):
        ok = ((root[a] != root[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
              & (~cross[a] | (side[a] != side[b])))
        for own in decided:
            ok &= (own[a] == 0) | (own[a] != own[b])
        return ok

    def keep(a, b, counts=None):
        if counts is not None:
            ok = _allowed(n[a], n[b], lengths[a], lengths[b], last[a], last[b], counts, percent)
            a, b = a[ok], b[ok]
        counts, first = pair_counts(flat, start, size, a, b)
        ok = _allowed(n[a], n[b], lengths[a], lengths[b], last[a], last[b], counts, percent) & (first == block[a])
        found.append(np.stack([sig[a[ok]], sig[b[ok]]]))

    cuts = np.append(np.flatnonzero(np.diff(tile, prepend=tile[:1] - 1)), len(tile))
    rows = np.diff(cuts)
    small = np.repeat(rows <= SMALL_TILE, rows)
    for d in range(1, min(SMALL_TILE, int(rows.max(initial=1)))):
        a = np.arange(len(tile) - d)
        a = a[(tile[a] == tile[a + d]) & small[a] & may_pair(a, a + d)]
        if len(a):
            keep(a, a + d)
    for lo, hi in zip(cuts[:-1][rows > SMALL_TILE], cuts[1:][rows > SMALL_TILE], strict=True):
        own = flat[start[lo]:start[hi - 1] + size[hi - 1]]
        order = np.argsort(own, kind="stable")
        keys, holders = own[order], np.repeat(np.arange(hi - lo), size[lo:hi])[order]
        for a in range(lo, hi - 1):
            b = np.arange(a + 1, hi)
            b = b[may_pair(np.full(len(b), a), b)]
            if len(b):
                mine = flat[start[a]:start[a] + size[a]]
                left, right = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
                met = np.concatenate([holders[i:j] for i, j in zip(left, right, strict=True)])
                keep(np.full(len(b), a), b, np.bincount(met, minlength=hi - lo)[b - lo])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    every = np.sort(np.concatenate(found, axis=1), axis=0)
    return every[0], every[1]


def _tiles(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """``tile_pairs`` over a stream sorted by tile; whole tiles are taken as they
    come, the last one waits for its other rows."""
    def done(rows: pa.Table, tile: np.ndarray) -> pa.RecordBatch:
        a, b = tile_pairs(tile, rows["lo"].to_numpy() != rows["hi"].to_numpy(),
                          *(rows[c].to_numpy() for c in ("c", "sig", "n", "root", "t")),
                          rows["last"].to_numpy().view(np.uint64),
                          [x for chunk in rows["cols"].chunks for x in _lists(chunk)], percent,
                          [rows[f"t{k}"].to_numpy() for k in range(TILE_ROUNDS)])
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        parts = np.stack([held[c].to_numpy() for c in ("c", "lo", "hi")], axis=1)
        tile = np.cumsum(np.append(False, (parts[1:] != parts[:-1]).any(axis=1)))
        cut = int(np.searchsorted(tile, tile[-1]))
        if cut:
            yield done(held.slice(0, cut), tile[:cut])
            held = held.slice(cut)
    if held is not None:
        yield done(held, np.zeros(held.num_rows, np.int64))


def _roots(links: DataFrame) -> DataFrame:
    """``sig, root`` of every set in a link."""
    nodes = links.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    found = connected_components(nodes, links.select(F.col("a").alias("src"), F.col("b").alias("dst")), node="sig")
    return found.select("sig", F.col("component").alias("root"))


_TILES = [f"t{k}" for k in range(TILE_ROUNDS)]


def _undecided(x: str, y: str, percent: int) -> Column:
    """Whether the rows in two struct columns are of different components and near sizes,
    and no tile has decided them."""
    p, q = F.col(x), F.col(y)
    out = (p["root"] != q["root"]) & (F.lit(100) * F.least(p["n"], q["n"]) >= F.lit(percent) * F.greatest(p["n"], q["n"]))
    for t in _TILES:
        out = out & ((p[t] == 0) | (p[t] != q[t]))
    return out


def _small_pairs(open_: DataFrame, percent: int) -> DataFrame:
    """``a, b``: the undecided pairs of blocks of at most ``SMALL_BLOCK`` rows."""
    row = F.struct("sig", "n", "root", *_TILES)
    blocks = open_.filter(F.col("m") <= SMALL_BLOCK).groupBy("c").agg(F.collect_list(row).alias("r"))
    firsts = blocks.select("r", F.posexplode("r").alias("i", "x"))
    both = firsts.select("x", F.explode(F.slice("r", F.col("i") + 2, F.lit(SMALL_BLOCK))).alias("y"))
    return both.filter(_undecided("x", "y", percent)).select(
        F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b")).distinct()


def _large_pairs(open_: DataFrame, rows: DataFrame, percent: int, tile: int) -> DataFrame:
    """``a, b``: the undecided pairs of larger blocks that the prefix columns allow."""
    large = open_.filter(F.col("m") > SMALL_BLOCK)
    # a row's columns in open blocks: rows of different components share no others
    carried = (open_.join(large.select("sig").distinct(), "sig", "left_semi")
               .groupBy("sig").agg(F.sort_array(F.collect_set("c")).alias("cols"))
               .join(rows.select("sig", F.element_at("prefix", -1).alias("last")), "sig"))
    sides = F.ceil(F.col("m") / F.lit(tile)).cast("long")
    mine = F.pmod(F.xxhash64("sig", F.lit(3)), sides)
    own = ["c", "lo", "hi", "sig", "n", "root", "t", *_TILES]
    tiles = (large.withColumn("t", mine).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), sides - 1)))
             .withColumns({"lo": F.least("t", "k"), "hi": F.greatest("t", "k")}).select(*own)
             .join(carried, "sig").select(*own, "cols", "last")
             .repartition("c", "lo", "hi").sortWithinPartitions("c", "lo", "hi"))
    return tiles.mapInArrow(_lean(lambda it: _tiles(it, percent)), "a long, b long").distinct()


def _spread(big: DataFrame, keyed: DataFrame, key: str, rows: int) -> DataFrame:
    """Left join with a row per key, where a key may hold a large share of the ``rows`` of ``big``."""
    policy = HotKeys()
    often = []
    if rows > policy.min_rows:
        often = hot_keys(big.groupBy(key).agg(F.count(F.lit(1)).alias("_deg")), key, "_deg", rows, policy)
    return split_join(big, keyed, key, often, "left")


def _rooted(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, tile: int = TILE,
            rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, th, n, root``; rows of one component share ``root``
    (rows without a word are in none)."""
    spark = docs.sparkSession
    store = RoundStore(spark, "ngram-join")
    matrix = store.put(incidence(docs, size, percent), "incidence")
    # one row per distinct set; a copy group of any size is combined before the shuffle
    firsts = matrix.filter(F.size("prefix") > 0).groupBy("sig").agg(F.min("doc_id").alias("_id"))
    rows = matrix.join(firsts.withColumnRenamed("sig", "_s"),
                       (F.col("sig") == F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    rows = store.put(rows.dropDuplicates(["sig"]), "rows")

    entries = rows.select(F.explode("prefix").alias("c"), "sig", "n")
    # columns of n-grams in the common list are negative: only they can be hot keys, and are counted before they
    # are joined; the others take one shuffle, which brings a block's rows together
    often, rare = entries.filter("c < 0"), entries.filter("c >= 0")
    shared = often.groupBy("c").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > 1)
    met = rare.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("c"))).filter(F.col("m") > 1)
    none = {t: F.lit(0).cast("long") for t in _TILES}
    open_ = (often.join(shared, "c").select("c", "sig", "n", "m").unionByName(met.select("c", "sig", "n", "m"))
             .select("c", "sig", "n", "m", F.col("sig").alias("root")).withColumns(none))
    open_ = store.put(open_, "open", keep=1)
    links = spark.createDataFrame([], "a long, b long")

    def contracted(found: DataFrame, k: int) -> DataFrame:
        roots = store.put(_contracted(open_.select("sig", "root").distinct(), found, k, store), "roots", keep=1)
        return store.put(_open(open_, roots), "open", keep=2)

    for k in range(rounds):
        pivots = open_.groupBy("c").agg(F.min(F.struct(F.xxhash64("root", F.lit(k)).alias("h"), "sig", "n", "root")).alias("p"))
        met = open_.join(pivots, "c").filter(
            (F.col("root") != F.col("p.root"))
            & (F.lit(100) * F.least("n", "p.n") >= F.lit(percent) * F.greatest("n", "p.n")))
        pairs = met.groupBy("sig").agg(F.min("p").alias("p")).select(
            F.least("sig", "p.sig").alias("a"), F.greatest("sig", "p.sig").alias("b")).distinct()
        found = _verified(pairs, rows, docs, size, percent, store)
        links = links.unionByName(found)
        open_ = contracted(found, k)
    for k, t in enumerate(_TILES):
        found, tiles = _tiled(open_, rows, docs, k, size, percent, store)
        links = links.unionByName(found)
        known = open_.drop(t).join(tiles.withColumnRenamed("tile", t), "sig", "left").fillna(0, [t])
        open_ = store.put(known.select("c", "sig", "n", "m", "root", *_TILES), "open", keep=2)
        open_ = contracted(found, rounds + k)

    more = store.put(_small_pairs(open_, percent).unionByName(_large_pairs(open_, rows, percent, tile)).distinct(), "tiles")
    links = links.unionByName(_verified(more, rows, docs, size, percent, store))

    found = _roots(links)
    store.drop("open", "tiles", "rows", "roots", "up", "links", *(f"tiled{k}" for k in range(TILE_ROUNDS)))
    light = matrix.select("doc_id", "th", "n", "sig")
    return _spread(light, found, "sig", light.count()).select("doc_id", "th", "n", F.coalesce("root", "sig").alias("root"))


def components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, tile: int = TILE,
               rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id``."""
    light = _rooted(docs, size, percent, tile, rounds)
    least = light.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = _spread(light.filter("n > 0"), least, "root", light.count()).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = light.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(empty)


def _contracted(roots: DataFrame, links: DataFrame, k: int, store: RoundStore) -> DataFrame:
    """``sig, root`` after ``links``: each linked root points to the neighbour root of
    least hash, if that is less than its own, and pointers are followed eight
    steps. Equal roots are always connected; the converse need not hold yet (what
    is left apart is only compared again), so no iteration to the end is needed."""
    side = {x: roots.select(F.col("sig").alias(x), F.col("root").alias("r" + x)) for x in "ab"}
    ends = links.join(side["a"], "a").join(side["b"], "b").filter("ra <> rb").select("ra", "rb").distinct()
    ha, hb = F.xxhash64("ra", F.lit(k)), F.xxhash64("rb", F.lit(k))
    arrows = ends.select(F.when(ha > hb, F.col("ra")).otherwise(F.col("rb")).alias("x"),
                         F.when(ha > hb, F.struct(hb.alias("h"), F.col("rb").alias("y")))
                         .otherwise(F.struct(ha.alias("h"), F.col("ra").alias("y"))).alias("to"))
    up = store.put(arrows.groupBy("x").agg(F.min("to").alias("to")).select("x", F.col("to.y").alias("y")), "up", keep=1)
    for _ in range(3):
        nxt = up.select(F.col("x").alias("y"), F.col("y").alias("z"))
        up = up.join(nxt, "y", "left").select("x", F.coalesce("z", "y").alias("y"))
    return roots.join(up, roots["root"] == up["x"], "left").select("sig", F.coalesce("y", "root").alias("root"))


def _open(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of blocks that hold several components, not all met in one tile, with their roots."""
    rooted = (blocks.drop("root").join(known, "sig", "left")
              .select("c", "sig", "n", "m", F.coalesce("root", "sig").alias("root"), *_TILES))
    apart = F.min("root") != F.max("root")
    for t in _TILES:
        apart = apart & ((F.min(t) != F.max(t)) | (F.min(t) == 0))
    several = rooted.groupBy("c").agg(apart.alias("_apart")).filter("_apart").select("c")
    return rooted.join(several, "c", "left_semi")


def keep(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One document of each group (the smallest id, then the least text hash; a row
    without an id only where no other has one) and every document without links,
    whole rows with all columns. Rows that repeat an id and its text count once;
    texts without a word are in no group, and those without an id all stay."""
    light = _rooted(docs, size, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "th")).alias("f")
    grouped = light.filter("n > 0").groupBy("root").agg(first).select("f.doc_id", "f.th")
    wordless = light.filter("n = 0 AND doc_id IS NOT NULL").select("doc_id", "th").distinct()
    i, t, h = (fresh(docs, c) for c in ("_id", "_th", "_t"))
    chosen = grouped.unionByName(wordless).select(F.col("doc_id").alias(i), F.col("th").alias(t))
    loose = F.col("doc_id").isNull() & (F.translate(F.coalesce("text", F.lit("")), SEPARATORS.decode(), "") == "")
    named = docs.filter(~loose).withColumn(h, _text_hash())
    named = named.join(chosen, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(h) == F.col(t)), "left_semi")
    return named.dropDuplicates(["doc_id", h]).drop(h).unionByName(docs.filter(loose))


def oracle(size: int = SIZE, percent: int = PERCENT) -> str:
    """DuckDB: sets of n-gram strings, every pair with a shared n-gram, reachability."""
    return f"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i:i + {size - 1}], ' '))) END AS g FROM t),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS i, b.doc_id AS j FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
      WHERE 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n
      HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT p.j, r.c FROM r JOIN p ON r.doc_id = p.i)
SELECT r.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(c) AS component_id
FROM r JOIN s ON r.doc_id = s.doc_id GROUP BY r.doc_id, len(s.g)"""
