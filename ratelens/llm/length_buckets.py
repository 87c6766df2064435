"""Packing: optimal length buckets.

A global histogram of piece lengths (at most ``context`` rows) goes through a
dynamic program that chooses at most ``buckets`` boundaries with the least
padding; each piece is padded to its bucket's boundary, and batches of at most
``budget`` padded tokens form inside each bucket.

A text of more than ``context`` tokens is cut into pieces of ``context`` tokens,
so no token is dropped.  Inside a bucket pieces are in the order of a hash of
their id; batch = position // capacity.  Positions come from a range
partitioning by (bucket, hash) that is written once: position inside the
partition plus the sum of earlier partitions' counts, so a bucket that holds a
third of all rows is spread like any other.

Defined results: null text = empty text, one piece of 0 tokens; pieces of 0
tokens share the first bucket; rows with a null id are packed too; repeated rows
are packed each; an empty table has no batches; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratelens.llm.common import written
from ratelens.llm.token_counts import lengths

CONTEXT = 2048
BUDGET = 65_536
BUCKETS = 12


@dataclass(frozen=True)
class Plan:
    """Ascending upper boundaries and the padding they cost over the histogram."""
    boundaries: tuple[int, ...]
    padding: int


def best_boundaries(lengths_: list[int], counts: list[int], buckets: int = BUCKETS) -> Plan:
    """Least total padding with at most ``buckets`` boundaries, each a length
    that occurs, the last the longest.  ``cost(i, j)`` = padding when lengths
    i..j-1 are padded to length j-1; the program runs over (buckets, end)."""
    order = np.argsort(lengths_)
    length = np.asarray(lengths_, np.int64)[order]
    count = np.asarray(counts, np.int64)[order]
    n = len(length)
    if not n:
        return Plan((), 0)
    docs = np.concatenate([[0], np.cumsum(count)])
    tokens = np.concatenate([[0], np.cumsum(count * length)])
    best = np.full(n + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    back = []
    for _ in range(min(buckets, n)):
        new, cut = best.copy(), np.full(n + 1, -1, np.int64)
        for j in range(1, n + 1):
            total = best[:j] + length[j - 1] * (docs[j] - docs[:j]) - (tokens[j] - tokens[:j])
            i = int(total.argmin())
            if total[i] < new[j]:
                new[j], cut[j] = total[i], i
        back.append(cut)
        best = new
    edges, j = [], n
    for cut in reversed(back):
        if j and cut[j] >= 0:
            edges.append(int(length[j - 1]))
            j = int(cut[j])
    return Plan(tuple(reversed(edges)), int(best[n]))


def pieces(counted: DataFrame, context: int = CONTEXT) -> DataFrame:
    """``doc_id, piece, n_tokens`` of at most ``context`` tokens each."""
    last = F.greatest(F.lit(0), F.floor((F.col("n_tokens") - 1) / F.lit(context)))
    out = counted.select("doc_id", F.col("n_tokens").alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece"))
    return out.select("doc_id", F.col("piece").cast("int").alias("piece"),
                      F.least(F.lit(context), F.col("_n") - F.col("piece") * F.lit(context)).cast("int").alias("n_tokens"))


def pack(docs: DataFrame, path: str, context: int = CONTEXT, budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, piece, n_tokens, bucket, pad_to, batch, slot`` for every piece of
    every whole text; (bucket, batch) is a batch, slot the place in it."""
    if budget < context:
        raise ValueError("a batch must hold a full context")
    spark = docs.sparkSession
    parts = written(spark, pieces(lengths(docs, path), context), "pack-pieces")
    # at most context + 1 rows, whatever the input
    hist = parts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()
    plan = best_boundaries([r.n_tokens for r in hist], [r.n for r in hist], buckets)
    return batches(parts, plan, budget)


def batches(parts: DataFrame, plan: Plan, budget: int = BUDGET) -> DataFrame:
    spark = parts.sparkSession
    edges = plan.boundaries or (0,)
    bucket, pad_to = F.lit(len(edges) - 1), F.lit(edges[-1])
    for k in range(len(edges) - 2, -1, -1):
        inside = F.col("n_tokens") <= F.lit(edges[k])
        bucket, pad_to = F.when(inside, F.lit(k)).otherwise(bucket), F.when(inside, F.lit(edges[k])).otherwise(pad_to)
    # pieces of rows with one id, or none, are alike in all but their number in the written table
    keys = ["bucket", "_h", "doc_id", "piece", "_r"]
    ranged = (parts.withColumn("bucket", bucket).withColumn("pad_to", pad_to)
              .withColumn("_h", F.xxhash64("doc_id", "piece")).withColumn("_r", F.monotonically_increasing_id())
              .repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumn("_p", F.spark_partition_id())
              .withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    ranged = written(spark, ranged, "pack-ranged")
    # (partition, bucket) pairs: at most partitions + buckets rows
    counts = ranged.groupBy("bucket", "_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = Window.partitionBy("bucket").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    position = F.col("_before") + F.col("_i") - F.col("_first")
    capacity = F.floor(F.lit(budget) / F.greatest(F.col("pad_to"), F.lit(1)))
    return (ranged.join(F.broadcast(offsets), ["bucket", "_p"])
            .select("doc_id", "piece", "n_tokens", "bucket", "pad_to", F.floor(position / capacity).alias("batch"),
                    (position % capacity).cast("int").alias("slot")))
