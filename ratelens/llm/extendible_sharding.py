"""Sharding: extendible hashing, in DataFrame operations only.

A document's key is hashed to ``MAX_BITS`` bits.  The directory is indexed by
hash-prefix bits; a bucket over the byte limit splits on its next bit, and only
such buckets split, until every shard fits.  So a document's shard is the
shortest prefix of its hash whose bucket fits the limit or holds one document.

All depths of a level of ``LEVEL`` bits are summed at once from sums per finest
prefix (partial aggregation: no bucket is gathered in a task), and only the
documents of buckets that are still too large go to the next level.  Each level
is written to the shared folder.

Rows that share one hash cannot be parted by bits.  Where such rows exceed the
limit they are dealt to overflow pages of the bucket (``page`` > 0), in the
order of a hash of the text, by running sums over written partitions: the limit
holds there, too.  A single document over the limit is a shard of its own.

Defined results: null text = 0 bytes; a null id hashes as the text ``null``;
repeated rows share a hash; an empty table has no shard; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.llm.common import fresh, written
from ratelens.operators.skew import HotKeys, hot_keys, split_join

MAX_BITS = 60
LEVEL = 12
LIMIT = 1 << 20


def key_hash(key: Column) -> Column:
    """The first 60 bits of the md5 of the key's text, as a long."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, MAX_BITS // 4), 16, 10).cast("long")


def assign(docs: DataFrame, key: str = "doc_id", limit: int = LIMIT, level: int = LEVEL) -> DataFrame:
    """Per row: ``key, n_bytes, depth, prefix, page, shard_bytes, shard_docs``;
    (depth, prefix, page) names the shard."""
    spark = docs.sparkSession
    rows = written(spark, docs.select(
        F.col(key).alias("_k"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("_b"),
        key_hash(F.col(key)).alias("_hash"), F.xxhash64("text").alias("_t")), "shard-rows")
    done, base = [], 0
    while True:
        top = min(base + level, MAX_BITS)
        fine = (rows.groupBy(F.shiftright("_hash", MAX_BITS - top).alias("_f"))
                .agg(F.sum("_b").alias("_fb"), F.count(F.lit(1)).alias("_fn")))
        depths = F.explode(F.sequence(F.lit(base), F.lit(top))).alias("_d")
        at = fine.select("_f", "_fb", "_fn", depths).withColumn(
            "_p", F.expr(f"shiftright(_f, cast({top} - _d as int))"))
        sums = at.groupBy("_d", "_p").agg(F.sum("_fb").alias("_sb"), F.sum("_fn").alias("_sn"))
        fits = sums.filter((F.col("_sb") <= F.lit(limit)) | (F.col("_sn") == 1))
        leaf = (at.join(fits, ["_d", "_p"]).groupBy("_f")
                .agg(F.min(F.struct("_d", "_p", "_sb", "_sn")).alias("_l")).select("_f", "_l.*"))
        # a repeated id makes its prefix a hot key of the rows
        total = rows.count()
        often = []
        if total > HotKeys().min_rows:
            often = hot_keys(fine, "_f", "_fn", total, HotKeys())
        placed = split_join(rows.withColumn("_f", F.shiftright("_hash", MAX_BITS - top)), leaf, "_f", often, "left").drop("_f")
        placed = written(spark, placed, "shard-level")
        done.append(placed.filter(F.col("_d").isNotNull()).select(
            "_k", "_b", "_d", "_p", F.lit(0).cast("long").alias("_page"), "_sb", "_sn"))
        rows = placed.filter(F.col("_d").isNull()).select("_k", "_b", "_hash", "_t")
        if rows.isEmpty():
            break
        if top == MAX_BITS:
            done.append(_pages(rows, limit))
            break
        base = top
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("_k").alias(key), F.col("_b").alias("n_bytes"), F.col("_d").cast("int").alias("depth"),
                      F.col("_p").alias("prefix"), F.col("_page").alias("page"), F.col("_sb").alias("shard_bytes"),
                      F.col("_sn").alias("shard_docs"))


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of buckets whose rows share one hash: a page ends where the
    next half limit begins (rows up to half the limit pack at least half a
    page; larger rows have pages of their own)."""
    spark = rows.sparkSession
    big = F.col("_b") > F.lit(limit // 2)
    # equal texts of one hash are parted by their number in the written table
    order = ["_hash", "_big", "_t", "_r"]
    ranged = (rows.withColumn("_big", big).withColumn("_r", F.monotonically_increasing_id())
              .repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_part", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    ranged = written(spark, ranged, "shard-pages")
    # running sums inside slices of a partition, then of slices: no hash is gathered in one task
    sliced = ranged.withColumn("_s", F.floor(F.col("_i") / F.lit(4096)))
    inside = Window.partitionBy("_hash", "_big", "_s").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    own = sliced.withColumn("_ob", F.coalesce(F.sum("_b").over(inside), F.lit(0))).withColumn(
        "_on", F.row_number().over(Window.partitionBy("_hash", "_big", "_s").orderBy("_i")) - 1)
    slices = sliced.groupBy("_hash", "_big", "_s").agg(F.sum("_b").alias("_cb"), F.count(F.lit(1)).alias("_cn"))
    earlier = Window.partitionBy("_hash", "_big").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("_hash", "_big", "_s", F.coalesce(F.sum("_cb").over(earlier), F.lit(0)).alias("_eb"),
                           F.coalesce(F.sum("_cn").over(earlier), F.lit(0)).alias("_en"))
    at = own.join(slices, ["_hash", "_big", "_s"])
    half = max(1, limit // 2)
    page = F.when(F.col("_big"), (F.col("_on") + F.col("_en")) * 2 + 1).otherwise(
        F.floor((F.col("_ob") + F.col("_eb")) / F.lit(half)) * 2)
    at = at.withColumn("_page", page.cast("long"))
    sums = at.groupBy("_hash", "_page").agg(F.sum("_b").alias("_sb"), F.count(F.lit(1)).alias("_sn"))
    return at.join(sums, ["_hash", "_page"]).select(
        "_k", "_b", F.lit(MAX_BITS).alias("_d"), F.col("_hash").alias("_p"), "_page", "_sb", "_sn")


def directory(assigned: DataFrame) -> DataFrame:
    """The shards: ``depth, prefix, page, first_hash, last_hash, shard_bytes,
    shard_docs``; a key belongs to the row whose hash range holds its hash."""
    shards = assigned.groupBy("depth", "prefix", "page").agg(F.max("shard_bytes").alias("shard_bytes"),
                                                             F.max("shard_docs").alias("shard_docs"))
    first = F.expr(f"shiftleft(prefix, cast({MAX_BITS} - depth as int))")
    last = F.expr(f"shiftleft(prefix + 1, cast({MAX_BITS} - depth as int)) - 1")
    return shards.select("depth", "prefix", "page", first.alias("first_hash"), last.alias("last_hash"), "shard_bytes",
                         "shard_docs")


def write(docs: DataFrame, assigned: DataFrame, path: str, key: str = "doc_id") -> None:
    """Every row of ``docs``, all columns, as Parquet folders by shard, from ``assign``'s rows.

    An id's rows share a shard, except on overflow pages: there rows equal in id and size are
    dealt to the places of such rows, each to one (both sides number their equals), so null
    and repeated ids are neither lost nor multiplied.  The folder column is ``shard``
    (lengthened where ``docs`` has one)."""
    k, b, i, n, shard = (fresh(docs, c) for c in ("_k", "_b", "_i", "_n", "shard"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    place = assigned.select(F.col(key).alias(k), F.col("n_bytes").alias(b),
                            F.concat_ws("-", "depth", F.hex("prefix"), "page").alias(shard))
    per = place.groupBy(k, b).agg(F.min(shard).alias(shard), (F.min(shard) != F.max(shard)).alias(n))
    here = F.col(key).eqNullSafe(F.col(k)) & (size == F.col(b))
    single = docs.join(per.filter(~F.col(n)), here).select(*docs.columns, shard)
    several = per.filter(n).select(k, b)
    places = _numbered(place.join(several.select(F.col(k).alias("_mk"), F.col(b).alias("_mb")),
                                  F.col(k).eqNullSafe(F.col("_mk")) & (F.col(b) == F.col("_mb")), "left_semi"), [k, b], i)
    equals = _numbered(docs.join(several, here).select(*docs.columns, F.col(b).alias(n)), [key, n], fresh(docs, "_at"))
    dealt = equals.join(places, F.col(key).eqNullSafe(F.col(k)) & (F.col(n) == F.col(b)) & (F.col(fresh(docs, "_at")) == F.col(i)))
    every = single.unionByName(dealt.select(*docs.columns, shard))
    # a shard has at most the byte limit, or one row
    every.repartition(shard).write.partitionBy(shard).parquet(path)


def _numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with a number, from 0, among those equal in ``keys``: numbers inside a written
    partition, then offsets from a row per (partition, key); no group is gathered."""
    x, r, p, at, first, n, before = (fresh(rows, c) for c in ("_x", "_r", "_p", "_i0", "_first", "_rows", "_before"))
    ranged = (rows.withColumn(x, F.xxhash64(*keys)).withColumn(r, F.monotonically_increasing_id())
              .repartitionByRange(x, r).sortWithinPartitions(x, r)
              .withColumn(p, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()))
    ranged = written(rows.sparkSession, ranged, "shard-equals")
    runs = ranged.groupBy(x, p).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(n))
    earlier = Window.partitionBy(x).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(x, p, first, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    return ranged.join(runs, [x, p]).withColumn(name, F.col(before) + F.col(at) - F.col(first)).select(*rows.columns, name)


def oracle(limit: int = LIMIT, deepest: int = 40) -> str:
    """DuckDB: sizes of every prefix of every document, the shortest that fits."""
    return f"""
WITH h AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS hash
           FROM documents),
every AS (SELECT doc_id, n_bytes, d, hash >> (60 - d) AS p FROM h, (SELECT unnest(range(0, {deepest + 1})) AS d)),
sums AS (SELECT d, p, sum(n_bytes) AS sb, count(*) AS sn FROM every GROUP BY d, p),
leaf AS (SELECT e.doc_id, e.n_bytes, min(e.d) AS d FROM every e JOIN sums ON e.d = sums.d AND e.p = sums.p
         WHERE sb <= {limit} OR sn = 1 GROUP BY e.doc_id, e.n_bytes)
SELECT e.doc_id, e.n_bytes, CAST(e.d AS INTEGER) AS depth, CAST(e.p AS BIGINT) AS prefix,
       CAST(0 AS BIGINT) AS page, CAST(sb AS BIGINT) AS shard_bytes, CAST(sn AS BIGINT) AS shard_docs
FROM every e JOIN leaf ON e.doc_id = leaf.doc_id AND e.d = leaf.d JOIN sums ON e.d = sums.d AND e.p = sums.p"""
