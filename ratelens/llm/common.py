"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.operators.skew import HotKeys, hot_keys, split_join
from ratelens.session import RoundStore

#: Records of one Arrow batch: bounds a Python task's memory when texts are long.
BATCH_RECORDS = 1000

#: The six separators between words (ASCII white space): what ``bytes.split()`` splits on.
SEPARATORS = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_RECORDS))


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared checkpoint folder and scanned back: the
    lineage ends here, and the table survives any executor."""
    return RoundStore(spark, name).put(df, "t")


def opened(uri: str, write: bool = False):
    """A file by path or URI (what ``pyarrow.fs`` opens), to write or for random access."""
    system, path = fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)
    if write:
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(path, compression=None)  # a name in .gz is no order to compress
    return system.open_input_file(path)


#: Rows of a keyed table that ``joined`` broadcasts at most.
BROADCAST_ROWS = 1_000_000


def joined(big: DataFrame, keyed: DataFrame, key: str, n: str, total, how: str = "inner",
           most: int | None = None, hot: HotKeys = HotKeys()) -> DataFrame:
    """``big`` with ``keyed`` (written; a row per key, ``n`` = rows of the key in ``big``, whose rows
    are ``total``): ``big`` stays in place while ``keyed`` is counted to be small, else
    hot keys are broadcast and the rest is shuffled. Keys are never null."""
    if keyed.count() <= (BROADCAST_ROWS if most is None else most):
        return big.join(F.broadcast(keyed), key, how)
    return split_join(big, keyed, key, hot_keys(keyed, key, n, total, hot), how)


def fold(doc_id: str | Column) -> Column:
    """crc32 of the id's decimal text, modulo 4 (2 = held out); null ids: 0."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % F.lit(4), F.lit(0)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int,
                    where: Column | None = None) -> DataFrame:
    """At most ``limit`` labelled documents outside the held-out fold, in the
    order of a hash of the id: ``doc_id, text, y``.  Contradicting repeats of a
    label count as their maximum.  Ids first (light), texts by ``sampled``."""
    ids = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold("doc_id") != 2))
           .groupBy("doc_id").agg(F.max(label).cast("int").alias("y")))
    if where is not None:
        ids = ids.filter(where)
    return sampled(docs, ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit), limit)


def sampled(docs: DataFrame, ids: DataFrame, limit: int) -> DataFrame:
    """The texts of ``ids`` (distinct, bounded) with the columns of ``ids``: one row for
    each different text of an id, at most ``limit`` rows in the order of a hash of id and
    text, so that repeated rows neither pass the bound nor fill the sample.  Repeats
    are combined and the order is taken on hashes; only chosen texts are carried."""
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").withColumn("_t", F.xxhash64("text"))
    keys = found.select("doc_id", "_t").distinct()
    keys = keys.orderBy(F.xxhash64("doc_id", "_t"), "doc_id", "_t").limit(limit)
    chosen = found.join(F.broadcast(keys), ["doc_id", "_t"], "left_semi")
    return chosen.dropDuplicates(["doc_id", "_t"]).drop("_t")


def texts(column: pa.Array) -> Iterator[bytes]:
    """Each text as UTF-8 bytes; a null text is empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def word_hashes(words: list[bytes] | list[str]) -> np.ndarray:
    """A 64-bit hash per word (text is hashed as UTF-8)."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_MULT = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: close inputs give unrelated outputs."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` consecutive word hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, size):
        out = mixed(out * _MULT + h[i:i + n])
    return out


def give_back() -> None:
    """Returns memory that this process has freed, but still holds, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def on_batches(fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table]):
    """``fn`` on every Arrow batch of a task that has rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]
    return run


def mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema) -> DataFrame:
    """``fn`` on every Arrow batch."""
    return df.mapInArrow(on_batches(fn), schema)
