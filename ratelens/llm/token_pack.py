"""Token-id output: fixed-width bit packing.

Each id takes the minimum bits of the vocabulary.  A file is

    header   magic ``TIDPACK1``, then unsigned 32-bit: bits per id, ids per block
    blocks   ids as a little-endian bit stream; each block starts on a byte
    footer   unsigned 64-bit per block: byte offset, first id; then block count, ids

so a range of ids is found by its block's offset (random access) and a block is
unpacked by numpy at once.

Documents are range-partitioned by id, sorted inside a partition and encoded in
a stream; every task writes one file in ascending ``doc_id`` order below the
shared folder, under a name of its own attempt, and returns a row per document
(file, place in the file, ids).  Those rows are a Parquet table that Spark
commits: the files of lost or repeated attempts are in no row, and are never
read.  ``start`` = ids of all earlier documents, from sums per file (one row per
partition).  Reading back is a second job over that table.

File systems: whatever ``pyarrow.fs`` opens by URI (local or mounted paths,
HDFS with libhdfs, S3, GCS).

Defined results: null text = empty text (the end id only); rows with a null id
come first; repeated ids stay in the order of their texts' hashes; an empty
table writes no file; extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratelens.llm.common import opened, texts, written
from ratelens.llm.encoding import encoder, vocabulary_size
from ratelens.session import shared_dir

MAGIC = b"TIDPACK1"
BLOCK_IDS = 1 << 16


def bits_for(vocabulary: int) -> int:
    """The least bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids (below ``2**bits``) as a little-endian bit stream, padded to a byte."""
    ids = np.ascontiguousarray(ids, "<u4")
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit {bits} bits")
    planes = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(planes.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a packed block."""
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype("<u4")
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = planes
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """Writes one file; ids come in any portions."""

    def __init__(self, stream, bits: int, block_ids: int = BLOCK_IDS):
        self.stream, self.bits, self.block_ids = stream, bits, block_ids
        self.blocks: list[tuple[int, int]] = []
        self.parts: list[np.ndarray] = []
        self.held = self.total = 0
        self.at = stream.write(MAGIC + struct.pack("<2I", bits, block_ids)) or len(MAGIC) + 8

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.blocks.append((self.at, self.total))
        self.stream.write(data)
        self.at += len(data)
        self.total += len(ids)

    def write(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            every = np.concatenate(self.parts)
            whole = len(every) - len(every) % self.block_ids
            for i in range(0, whole, self.block_ids):
                self._block(every[i:i + self.block_ids])
            self.parts, self.held = [every[whole:]], len(every) - whole

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.parts))
        self.stream.write(np.array(self.blocks, "<u8").tobytes() + struct.pack("<2Q", len(self.blocks), self.total))
        self.stream.close()


class Reader:
    """Random access to one file: ``read(start, n)`` ids, through a few kept blocks."""

    def __init__(self, stream, kept: int = 4):
        self.stream, self.kept = stream, kept
        size = stream.size()
        stream.seek(0)
        head = stream.read(16)
        if head[:8] != MAGIC:
            raise ValueError("not a packed id file")
        self.bits, self.block_ids = struct.unpack("<2I", head[8:])
        stream.seek(size - 16)
        count, self.total = struct.unpack("<2Q", stream.read(16))
        stream.seek(size - 16 - 16 * count)
        self.blocks = np.frombuffer(stream.read(16 * count), "<u8").reshape(-1, 2)
        self.end = size - 16 - 16 * count
        self.cache: OrderedDict[int, np.ndarray] = OrderedDict()

    def block(self, k: int) -> np.ndarray:
        if k not in self.cache:
            at, first = map(int, self.blocks[k])
            last = k + 1 == len(self.blocks)
            stop, ids = (self.end, self.total) if last else map(int, self.blocks[k + 1])
            self.stream.seek(at)
            self.cache[k] = unpack(self.stream.read(stop - at), self.bits, ids - first)
            if len(self.cache) > self.kept:
                self.cache.popitem(last=False)
        self.cache.move_to_end(k)
        return self.cache[k]

    def read(self, start: int, n: int) -> np.ndarray:
        if start < 0 or n < 0 or start + n > self.total:
            raise IndexError(f"ids {start}..{start + n} of {self.total}")
        out, size = [], self.block_ids
        while n:
            own = self.block(start // size)[start % size:start % size + n]
            out.append(own)
            start, n = start + len(own), n - len(own)
        return np.concatenate(out) if out else np.empty(0, "<u4")


def write(docs: DataFrame, path: str, end_id: int, folder: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encodes every whole text with the tokenizer at ``path``, writes the packed
    files and returns the index table ``doc_id, file, place, n_tokens, start``."""
    spark = docs.sparkSession
    bits = bits_for(max(vocabulary_size(path), end_id + 1))
    folder = folder or shared_dir(spark, f"packed-{uuid.uuid4().hex}")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        ids, writer, place = encoder(path).ids, None, 0
        task = TaskContext.get()
        name = f"{folder}/ids-{task.partitionId():05d}-{uuid.uuid4().hex}.bin"
        for batch in batches:
            if not batch.num_rows:
                continue
            writer = writer or Writer(opened(name, True), bits, block_ids)
            encoded = [ids(t) + end for t in texts(batch["text"])]
            sizes = np.array([len(e) // 4 for e in encoded], np.int64)
            places = place + np.cumsum(sizes) - sizes
            place += int(sizes.sum())
            writer.write(np.frombuffer(b"".join(encoded), "<u4"))
            yield pa.record_batch([batch["doc_id"].cast(pa.int64()), pa.array([task.partitionId()] * len(sizes), pa.int32()),
                                   pa.array([name] * len(sizes)), pa.array(places), pa.array(sizes)],
                                  ["doc_id", "shard", "file", "place", "n_tokens"])
        if writer:
            writer.close()

    # rows that share an id, or have none, are parted by their texts, and repeats of a text by where they were read
    keys = ["doc_id", "_t", "_r"]
    ordered = (docs.select("doc_id", "text", F.xxhash64("text").alias("_t"), F.monotonically_increasing_id().alias("_r"))
               .repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text"))
    index = written(spark, ordered.mapInArrow(run, "doc_id long, shard int, file string, place long, n_tokens long"),
                    "packed-index")
    # one row per partition: the window over them is small however many documents there are
    files = index.groupBy("shard", "file").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (index.join(F.broadcast(files), "file")
            .select("doc_id", "file", "place", "n_tokens", (F.col("_before") + F.col("place")).alias("start")))


def read(index: DataFrame) -> DataFrame:
    """Reads every document of an index table from its file: ``doc_id, start,
    n_tokens, ids_crc32, file`` (crc32 of the ids as little-endian unsigned 32-bit)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: OrderedDict[str, Reader] = OrderedDict()
        for batch in batches:
            sums = []
            for name, place, n in zip(batch["file"].to_pylist(), batch["place"].to_pylist(),
                                      batch["n_tokens"].to_pylist(), strict=True):
                if name not in readers:
                    readers[name] = Reader(opened(name))
                    if len(readers) > 8:
                        readers.popitem(last=False)[1].stream.close()
                sums.append(zlib.crc32(readers[name].read(place, n)))
            yield pa.record_batch([batch["doc_id"], batch["start"], batch["n_tokens"], pa.array(sums, pa.int64()),
                                   batch["file"]], ["doc_id", "start", "n_tokens", "ids_crc32", "file"])

    return index.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")
