"""Benchmark decontamination: spaced-seed hashing.

Words are runs of letters and digits in lower case. An overlap of a document
and a benchmark item is a window of ``WINDOW`` = 12 aligned words of which at
most ``SUBSTITUTIONS`` = 2 differ.

Seeds: the window is four blocks of three words, and each of the six masks looks
at two of the blocks and ignores the six words of the others. Two substitutions
spoil at most two blocks, so one mask is always hit: no overlap is missed. Every
hit is verified word by word, so chance hits and hash collisions add nothing.

Items shorter than a window count where all their words stand in the document in
a row; items without words match nothing.

The item table is the query set: every different text goes to the tasks once, in blocks of
at most ``BLOCK_CHARS`` characters (their sums are checked before a block is fetched;
a larger benchmark takes more passes, a single larger item raises), and each pass is one scan of whole texts without a shuffle: windows of a batch are
hashed by numpy, looked up, and only verified overlaps leave the task, one row
per document and item.

Defined results: null or empty texts and items match nothing; rows with a null
id are reported with it; repeated rows and repeated items are reported each;
an empty table on either side gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import BROADCAST_ROWS, mapped, texts, word_hashes, written

WINDOW, BLOCKS, SUBSTITUTIONS = 12, 4, 2
_PART = WINDOW // BLOCKS
#: Word offsets that each mask looks at; the others are ignored.
MASKS = tuple(tuple(b * _PART + i for b in pair for i in range(_PART))
              for pair in combinations(range(BLOCKS), BLOCKS - SUBSTITUTIONS))
BLOCK_CHARS = 16 << 20
_WORD = re.compile(r"[^\W_]+")
_FILTER_BITS = 22
SCHEMA = "doc_id long, item_id long, n_windows long, best_equal int, first_word long, last_word long"


def words(text: bytes) -> list[str]:
    return _WORD.findall(text.decode("utf-8", "replace").lower())


def _factors(n: int) -> np.ndarray:
    """Odd 64-bit multipliers, one per looked-at word."""
    return np.random.default_rng(17).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def seed_keys(h: np.ndarray, offsets: tuple[int, ...], span: int) -> np.ndarray:
    """The key of every window of ``span`` word hashes under a mask."""
    n = max(0, len(h) - span + 1)
    out = np.zeros(n, np.uint64)
    for factor, o in zip(_factors(len(offsets)), offsets, strict=True):
        out += h[o:o + n] * factor
    return out


@dataclass(frozen=True)
class Index:
    """Seeds of a block of items. ``kinds``: per mask (offsets, window) the sorted
    keys with the item and word they start at, and a bit filter of key prefixes."""
    ids: list
    hashes: list[np.ndarray]
    kinds: list[tuple]


def index(items: list[tuple[object, str]]) -> Index:
    ids = [i for i, _ in items]
    hashes = [word_hashes(words((t or "").encode())) for _, t in items]
    kinds = []
    spans = {WINDOW: MASKS} | {n: (tuple(range(n)),) for n in {len(h) for h in hashes} if 0 < n < WINDOW}
    for span, masks in spans.items():
        # a short item counts only as a whole
        own = [k for k, h in enumerate(hashes) if len(h) == span or (span == WINDOW and len(h) > WINDOW)]
        if not own:
            continue
        for offsets in masks:
            keys = [seed_keys(hashes[k], offsets, span) for k in own]
            item = np.repeat(np.array(own, np.int32), [len(k) for k in keys])
            at = np.concatenate([np.arange(len(k), dtype=np.int32) for k in keys])
            keys = np.concatenate(keys)
            order = np.argsort(keys, kind="stable")
            there = np.zeros(1 << _FILTER_BITS, bool)
            there[keys >> np.uint64(64 - _FILTER_BITS)] = True
            kinds.append((offsets, span, keys[order], item[order], at[order], there))
    return Index(ids, hashes, kinds)


def search(own: Index, bags: list[np.ndarray]) -> list[tuple[int, int, int, int, int, int]]:
    """Verified overlaps of documents (word hashes): ``(document, item, windows,
    most equal words, first and last word in the document)``."""
    if not bags:
        return []
    starts = np.cumsum([0] + [len(b) for b in bags])
    h = np.concatenate(bags)
    found = []
    for offsets, span, keys, item, at, there in own.kinds:
        got = seed_keys(h, offsets, span)
        spots = np.flatnonzero(there[got >> np.uint64(64 - _FILTER_BITS)])
        left = np.searchsorted(keys, got[spots], "left")
        n = np.searchsorted(keys, got[spots], "right") - left
        spots, left, n = spots[n > 0], left[n > 0], n[n > 0]
        if not len(spots):
            continue
        doc = np.searchsorted(starts, spots, "right") - 1
        inside = spots + span <= starts[doc + 1]  # not over the end of a document
        spots, left, n, doc = spots[inside], left[inside], n[inside], doc[inside]
        # a hit per pair of equal keys, portion by portion: many items may share a seed
        portion = np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), 1 << 20), "right")
        for a, b in zip(portion, [*portion[1:], len(n)], strict=True):
            b = max(b, a + 1)
            m = n[a:b]
            k = np.repeat(left[a:b] - np.cumsum(m) + m, m) + np.arange(m.sum())
            s, d, it, ip = np.repeat(spots[a:b], m), np.repeat(doc[a:b], m), item[k], at[k]
            equal = np.zeros(len(s), np.int32)
            flat_starts = np.cumsum([0] + [len(x) for x in own.hashes])
            flat = np.concatenate(own.hashes)
            for o in range(span):
                equal += h[s + o] == flat[flat_starts[it] + ip + o]
            ok = equal >= (span if span < WINDOW else WINDOW - SUBSTITUTIONS)
            found.append(np.stack([d[ok], it[ok], s[ok] - starts[d[ok]], ip[ok], equal[ok],
                                   np.full(ok.sum(), span)], axis=1))
    if not found:
        return []
    # the same window is hit by several masks
    every = np.unique(np.concatenate(found), axis=0)
    out = []
    pair = every[:, 0] * len(own.ids) + every[:, 1]
    cuts = np.flatnonzero(np.diff(pair)) + 1
    for rows in np.split(every, cuts) if len(every) else []:
        out.append((int(rows[0, 0]), int(rows[0, 1]), len(rows), int(rows[:, 4].max()), int(rows[:, 2].min()),
                    int((rows[:, 2] + rows[:, 5] - 1).max())))
    return out


def _items(benchmark: DataFrame) -> DataFrame:
    """``text, item``: every different text once (null = empty), with its MD5 as the item's name."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    items = benchmark.select(text).distinct().withColumn("item", F.md5(F.col("text").cast("binary")))
    return written(benchmark.sparkSession, items, "benchmark-items")


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of at most ``block_chars`` characters each, fetched one after another.

    Items fall into hash buckets; while a bucket is over the bound there are twice as many
    (different texts part in the end). One item over the bound raises."""
    total, longest = items.agg(F.sum(F.length("text")), F.max(F.length("text"))).first()
    if (longest or 0) > block_chars:
        raise ValueError(f"a benchmark item has {longest} characters, a block holds {block_chars}")
    n = max(1, -(-int(total or 0) // block_chars))
    while True:
        bucket = F.pmod(F.xxhash64("text"), F.lit(n))
        largest = items.groupBy(bucket.alias("b")).agg(F.sum(F.length("text")).alias("c")).agg(F.max("c")).first()[0]
        if (largest or 0) <= block_chars:
            break
        n *= 2
    for k in range(n):
        rows = items.filter(bucket == k).select("item", "text").collect()
        if rows:
            yield sorted((r.item, r.text) for r in rows)


def overlaps(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, n_windows, best_equal, first_word, last_word`` for every
    document and item with an overlap."""
    spark = docs.sparkSession
    parts = []
    found = SCHEMA.replace("item_id long", "item string")
    for items in _blocks(_items(benchmark), block_chars):
        own = spark.sparkContext.broadcast(index(items))

        def run(batch: pa.RecordBatch, own=own) -> pa.RecordBatch:
            ids = batch["doc_id"].to_pylist()
            got = search(own.value, [word_hashes(words(t)) for t in texts(batch["text"])])
            rows = [(ids[d], own.value.ids[i], *rest) for d, i, *rest in got]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                   [c.split()[0] for c in found.split(", ")])

        parts.append(mapped(docs.select("doc_id", "text"), run, found))
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    # items of one text were searched once; each of them is reported
    names = benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                             F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("item"))
    if benchmark.count() <= BROADCAST_ROWS:
        names = F.broadcast(names)
    return reduce(DataFrame.unionByName, parts).join(names, "item").select(*(c.split()[0] for c in SCHEMA.split(", ")))


def keep(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, without an overlap (a pass per block)."""
    spark = docs.sparkSession
    for items in _blocks(_items(benchmark), block_chars):
        own = spark.sparkContext.broadcast(index(items))

        def run(batch: pa.RecordBatch, own=own) -> pa.RecordBatch:
            got = search(own.value, [word_hashes(words(t)) for t in texts(batch["text"])])
            clean = np.ones(batch.num_rows, bool)
            clean[[row[0] for row in got]] = False
            return batch.filter(pa.array(clean))

        docs = mapped(docs, run, docs.schema)
    return docs


def oracle() -> str:
    """DuckDB: the same overlaps from joined seed words (no hashes)."""
    masked = " UNION ALL ".join(
        f"SELECT *, {m} AS mask, list_aggregate([{', '.join(f'w[p + {o}]' for o in offsets)}], 'string_agg', ' ') AS seed FROM win"
        for m, offsets in enumerate(MASKS))
    side = """{name}_w AS (SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}),
{name} AS (WITH win AS (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS p FROM {name}_w WHERE len(w) >= 12)
  SELECT {key}, p, mask, seed, w[p:p + 11] AS words FROM ({masked}))"""
    d = side.format(name="d", key="doc_id", table="documents", masked=masked)
    i = side.format(name="i", key="item_id", table="benchmark", masked=masked)
    return f"""
WITH {d},
{i},
hits AS (SELECT DISTINCT d.doc_id, i.item_id, d.p AS dp, i.p AS ip,
                len(list_filter(list_zip(d.words, i.words), lambda x: x[1] = x[2])) AS eq
         FROM d JOIN i ON d.mask = i.mask AND d.seed = i.seed),
short AS (SELECT item_id, w, len(w) AS n FROM i_w WHERE len(w) BETWEEN 1 AND 11),
whole AS (SELECT x.doc_id, s.item_id, x.p AS dp, 1 AS ip, s.n AS eq, s.n AS span
          FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d_w) x
          JOIN short s ON x.w[x.p] = s.w[1] WHERE x.w[x.p:x.p + s.n - 1] = s.w),
every AS (SELECT doc_id, item_id, dp, ip, eq, 12 AS span FROM hits WHERE eq >= 10 UNION ALL SELECT * FROM whole)
SELECT doc_id, item_id, count(*) AS n_windows, CAST(max(eq) AS INTEGER) AS best_equal,
       CAST(min(dp) - 1 AS BIGINT) AS first_word, CAST(max(dp + span - 2) AS BIGINT) AS last_word
FROM every GROUP BY doc_id, item_id"""
