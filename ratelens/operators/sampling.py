"""Deterministic sampling and splitting.

``DataFrame.sample`` / ``randomSplit`` depend on partition layout: the same seed
gives other rows after a repartition, a retried task or a re-read, so a saved
model could later be evaluated on its own training rows.  Here a row's fate is a
pure function of its key, the first 52 bits of an MD5 of the key's text:

    unit = int(md5(key1 | key2 | ... | seed)[:13], 16) / 2^52    in [0, 1)

Any SQL engine can compute the same unit (``unit_sql``), so samples compare row by row.
No shuffle, no driver round trip, stable under executor loss and re-planning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TWO_52 = float(1 << 52)


def hash_unit(keys: Sequence[str | Column], seed: int = 42) -> Column:
    """Uniform value in [0, 1) derived from the key only; a null key counts as empty text."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(_TWO_52)


def unit_sql(keys: Sequence[str], seed: int = 42) -> str:
    """``hash_unit`` of integer or text columns as DuckDB SQL."""
    text = " || '|' || ".join([*(f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys), f"'{seed}'"])
    return f"(CAST(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) AS DOUBLE) / {1 << 52})"


def _fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened until no column of ``df`` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def hash_sample(df: DataFrame, fraction: float, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Bernoulli sample without replacement: keep rows whose unit < fraction."""
    return df.filter(hash_unit(keys, seed) < F.lit(float(fraction)))


def hash_split(df: DataFrame, weights: Sequence[float], keys: Sequence[str],
               seed: int = 42) -> list[DataFrame]:
    """Disjoint, exhaustive split by normalised weights (like ``randomSplit``)."""
    total = float(sum(weights))
    bounds, acc = [], 0.0
    for w in weights:
        lo = acc
        acc += w / total
        bounds.append((lo, acc))
    u = hash_unit(keys, seed)
    parts = []
    for i, (lo, hi) in enumerate(bounds):
        cond = u >= F.lit(lo)
        if i < len(bounds) - 1:
            cond = cond & (u < F.lit(hi))
        parts.append(df.filter(cond))
    return parts


def hash_sample_n(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows: those with the smallest key hashes (rows
    that repeat a key tie and fill up together).  One ``TakeOrderedAndProject``:
    each task keeps its best ``n`` rows, whatever the keys look like."""
    u, = _fresh(df, "_u")
    return df.withColumn(u, hash_unit(keys, seed)).orderBy(u, *keys).limit(n).drop(u)


def in_first_part(label: str, keys: Sequence[str], fraction: float = 0.8, seed: int = 42) -> Column:
    """Row-level membership of ``stratified_split``'s first part (no join needed
    to tell training rows from held-out rows later)."""
    return hash_unit([label, *keys], seed) < F.lit(fraction)


def stratified_split(df: DataFrame, label: str, keys: Sequence[str], fraction: float = 0.8,
                     seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Per-stratum split: within each label value a row goes to the first part
    when its unit < fraction.  Every stratum is split with the same probability,
    independently of its size and of the layout (the ``sampleBy`` semantics
    without its layout dependence); no group is ever gathered in one task."""
    first = in_first_part(label, keys, fraction, seed)
    return df.filter(first), df.filter(~first)


def fold_of(keys: Sequence[str], k: int, seed: int = 42) -> Column:
    """Fold number 0..k-1 for k-fold / out-of-fold scoring."""
    return F.least(F.floor(hash_unit(keys, seed) * F.lit(k)).cast("int"), F.lit(k - 1))


def exact_stratified_split(df: DataFrame, label: str, keys: Sequence[str], fraction: float = 0.8,
                           seed: int = 42, max_classes: int = 1000) -> DataFrame:
    """Exact per-stratum split: in every stratum of n rows exactly
    ``floor(fraction * n)`` rows (those with the smallest key hashes) get
    ``first_part = true``.

    A window ordered within each stratum would gather a whole stratum in one
    task.  Instead the rows are range-partitioned by (stratum, hash, key) and
    written once (stable partition ids); each row's rank inside its stratum is
    the number of same-stratum rows in earlier partitions (prefix sums over a
    (partition, stratum) count table of at most partitions + strata rows, checked)
    plus its position inside its own partition.  Every step is a partitioned
    scan, a small aggregate or a join with that small table.
    """
    from pyspark.sql import Window

    from ratelens.session import RoundStore

    spark = df.sparkSession
    store = RoundStore(spark, "exact-split")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    u, salt, pid, pos, n, start, offset, total, opid, stratum = _fresh(
        df, "_u", "_salt", "_pid", "_pos", "_n", "_start", "_offset", "_total", "_opid", "_stratum")
    # rows that repeat a key tie; the partition they were read in spreads them over the ranges
    order = [F.col(label), F.col(u), *[F.col(k) for k in keys], F.col(salt)]
    ranged = (df.withColumn(u, hash_unit([label, *keys], seed)).withColumn(salt, F.monotonically_increasing_id())
              .repartitionByRange(n_parts, *order)
              .sortWithinPartitions(*order))
    # position inside the partition: monotonically_increasing_id is (pid << 33) + row index
    ranged = ranged.withColumn(pid, F.spark_partition_id()) \
        .withColumn(pos, F.monotonically_increasing_id() - (F.spark_partition_id().cast("long") * (1 << 33)))
    ranged = store.put(ranged, "ranged")
    counts = ranged.groupBy(pid, label).agg(F.count(F.lit(1)).alias(n), F.min(pos).alias(start))
    # rows are range-partitioned by stratum first, so (partition, stratum) pairs number at most
    # partitions + strata - 1: that bounds the broadcast offsets table
    bound = n_parts + max_classes
    if counts.limit(bound + 1).count() > bound:
        raise ValueError(f"more than {max_classes} strata in {label!r}")
    by_label = Window.partitionBy(label)
    before = by_label.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(pid, label, start,
                            F.coalesce(F.sum(n).over(before), F.lit(0)).alias(offset),
                            F.sum(n).over(by_label).alias(total))
    # the offsets table has at most partitions + strata rows (checked above): broadcast;
    # null-safe, because rows without a label are a stratum of their own
    offsets = offsets.withColumnsRenamed({pid: opid, label: stratum})
    ranked = ranged.join(F.broadcast(offsets), (F.col(pid) == F.col(opid))
                         & F.col(label).eqNullSafe(F.col(stratum)))
    rank = F.col(offset) + F.col(pos) - F.col(start)
    # floor(fraction * n) in exact decimal arithmetic (a double product can land just below an integer)
    quota = F.floor(F.col(total).cast("decimal(20,0)") * F.lit(str(fraction)).cast("decimal(20,10)"))
    return ranked.withColumn("first_part", rank < quota).select(*df.columns, "first_part")
