"""WARC archives: writing with revisit records, and a salvage reader.

Writing. A page is a ``response`` record (HTTP head and payload) or, where an earlier
page has the same payload of at least ``LEAST`` bytes, a ``revisit`` record that holds
the HTTP head only and names the response. Digests choose the responses: a light
aggregate of digests finds the shared ones, payloads are not shuffled. Every task
writes files of its own attempt, one gzip member (or plain record) each, and
returns a row per file; Spark commits those rows, so files of lost or repeated
attempts are in no row and are never read.

Reading. A task reads a file as a stream: at each place a gzip member or a plain
record must pass its checks (checksum of the member, version line, header lines, length,
end mark, block and payload digest). After a failed check the reader searches
for the next member mark or version line at which a record passes all of them,
logs the bytes between as a gap with the first reason, and goes on from there, so
damage costs the records it touches and no later ones. Files made elsewhere
are read the same way; their records have no page id.

Memory: one record (one member) and a window of the file.

Defined results: null html is an empty payload; a null url writes no target; control characters
of a url are percent-encoded; rows that repeat the smallest id of equal payloads are all responses;
rows without an id revisit the smallest id of their payload, and are all
responses where none has one; an empty table writes no file; an empty file
has no records and no gap; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import joined, opened, written
from ratelens.session import shared_dir

#: Payloads below this many bytes are never replaced by a revisit.
LEAST = 100
#: A file is closed once it holds this many bytes.
FILE_BYTES = 256 << 20
LEVEL = 5

VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Extension fields that carry the table's ids.
PAGE_ID, REFERS_TO = "X-Page-Id", "X-Refers-To-Page-Id"
_SPACE = uuid.UUID("5f0c7f0e-9b1e-5f43-8a53-0d5c54d1a2b7")


# -- records ------------------------------------------------------------------------

def record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    """A plain record; fields that are None are left out."""
    sha = hashlib.sha256(block).hexdigest()
    fields = {"WARC-Type": kind, **fields, "WARC-Block-Digest": f"sha256:{sha}", "Content-Length": str(len(block))}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return VERSION + head.encode() + b"\r\n" + block + END


def member(data: bytes, level: int = LEVEL) -> bytes:
    """``data`` as one gzip member."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(_SPACE, f'{page_id}:{digest}').urn}>"


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """The record of a page: a revisit of the page ``refers_to`` if that is given."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    again = refers_to is not None
    fields = {"WARC-Record-ID": record_id(page_id, digest), "WARC-Date": date,
              "WARC-Target-URI": None if url is None else _uri(url),
              "WARC-Profile": IDENTICAL if again else None,
              "WARC-Refers-To": record_id(refers_to, digest) if again else None,
              "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http;msgtype=response",
              PAGE_ID: None if page_id is None else str(page_id), REFERS_TO: str(refers_to) if again else None}
    return record("revisit" if again else "response", fields, head if again else head + payload)


# -- writing ------------------------------------------------------------------------

def planned(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``page_id, url, html, digest, refers_to``: what each page's record is."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        html.alias("html"), F.sha2(html, 256).alias("digest"))
    shared = (rows.filter(F.octet_length("html") >= least).groupBy("digest")
              .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
              .filter("_n > 1 AND _first IS NOT NULL"))
    shared = written(pages.sparkSession, shared, "warc-shared")
    found = joined(rows, shared, "digest", "_n", F.lit(pages.count()), "left")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("_first")), None).otherwise(F.col("_first"))
    return found.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, least: int = LEAST, file_bytes: int = FILE_BYTES,
          gzip: bool = True, date: str | None = None) -> DataFrame:
    """Writes a record per page below ``folder`` and returns ``file, n_records, n_bytes``."""
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, f"warc-{uuid.uuid4().hex}")
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    packed = member if gzip else bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, n, size = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.record_batch([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())],
                                   ["file", "n_records", "n_bytes"])

        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))
            for page_id, url, html, digest, refers_to in zip(*columns, strict=True):
                if out is None:
                    name, n = f"{folder}/pages-{uuid.uuid4().hex}.warc{'.gz' if gzip else ''}", 0
                    out = opened(name, True)
                    info = packed(record("warcinfo", {"WARC-Record-ID": f"<{uuid.uuid4().urn}>", "WARC-Date": date,
                                                      "Content-Type": "application/warc-fields"}, b"format: WARC file version 1.1\r\n"))
                    size = out.write(info) or len(info)
                data = packed(page_record(page_id, url, html, digest, refers_to, date))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return written(spark, planned(pages, least).mapInArrow(run, "file string, n_records long, n_bytes long"), "warc-files")


# -- salvage ------------------------------------------------------------------------

class Damaged(Exception):
    """A record or member fails a check."""


class Source:
    """Bytes of a file by place, through one held window."""

    def __init__(self, stream, window: int = 1 << 20):
        self.stream, self.window, self.size = stream, window, stream.size()
        self.at, self.held = 0, b""

    def read(self, at: int, n: int) -> bytes:
        """``n`` bytes from ``at``, fewer at the end of the file."""
        if not self.at <= at <= at + n <= self.at + len(self.held):
            self.stream.seek(min(at, self.size))
            self.at, self.held = at, self.stream.read(max(n, self.window))
        return self.held[at - self.at:at - self.at + n]

    def marks(self, at: int) -> Iterator[int]:
        """Places from ``at`` on where a gzip member or a record may start."""
        while at < self.size:
            data = bytes(self.read(at, self.window))
            stop = len(data) if at + len(data) >= self.size else len(data) - 16
            for found in MARK.finditer(data):
                if found.start() < stop:
                    yield at + found.start()
            at += stop


MARK = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d+\r\n")
_LINE = re.compile(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+:")
_HEAD_WINDOWS = (1 << 12, 1 << 16, 1 << 20, 1 << 24)


@dataclass
class Record:
    offset: int
    length: int
    fields: dict[str, str]
    block: bytes

    def http(self) -> tuple[bytes, bytes]:
        """HTTP head and payload; records of other content are all payload."""
        if self.fields.get("content-type", "").startswith("application/http"):
            head, mark, payload = self.block.partition(END)
            return head + mark, payload
        return b"", self.block


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "surrogateescape").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif _LINE.match(line):
            last, value = line.split(":", 1)
            last = last.lower()
            out[last] = value.strip()
        else:
            raise Damaged("header line")
    return out


def _checked(label: str, value: str | None, data: bytes) -> None:
    """Compares a digest field with the data; unknown algorithms pass."""
    name, _, want = (value or "").partition(":")
    if name.lower().replace("-", "") in ("sha256", "sha1", "md5") and want:
        got = hashlib.new(name.lower().replace("-", ""), data).digest()
        if want.lower() != got.hex() and want.upper().rstrip("=") != base64.b32encode(got).decode().rstrip("="):
            raise Damaged(f"{label} digest")


def plain_record(source: Source, at: int) -> Record:
    """The plain record at ``at``; raises ``Damaged`` where a check fails."""
    head, end = b"", -1
    for window in _HEAD_WINDOWS:
        head = source.read(at, window)
        if not re.match(rb"WARC/\d\.\d+\r\n", head):
            raise Damaged("version line")
        end = head.find(END)
        if end >= 0 or len(head) < window:
            break
    if end < 0:
        raise Damaged("end of header")
    fields = _fields(head[:end])
    if "warc-type" not in fields or not re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", "")):
        raise Damaged("needed fields")
    n, body = int(fields["content-length"]), at + end + 4
    if body + n + 4 > source.size:
        raise Damaged("cut off")
    if source.read(body + n, 4) != END:
        raise Damaged("end of record")
    block = bytes(source.read(body, n))
    _checked("block", fields.get("warc-block-digest"), block)
    out = Record(at, body + n + 4 - at, fields, block)
    if fields["warc-type"] == "response":
        _checked("payload", fields.get("warc-payload-digest"), out.http()[1])
    return out


def gzip_records(source: Source, at: int) -> tuple[list[Record], int]:
    """The records of the gzip member at ``at``, and where it ends."""
    unpacker, parts, place, step = zlib.decompressobj(31), [], at, 1 << 13
    try:
        while not unpacker.eof:
            data = source.read(place, step)
            if not data:
                raise Damaged("cut off")
            parts.append(unpacker.decompress(data))
            place, step = place + len(data), min(step * 2, 1 << 20)
    except zlib.error as wrong:
        raise Damaged("gzip member") from wrong
    end = place - len(unpacker.unused_data)
    inner, out, k = Source(pa.BufferReader(b"".join(parts))), [], 0
    while k < inner.size:
        own = plain_record(inner, k)
        k += own.length
        out.append(Record(at, end - at, own.fields, own.block))
    if not out:
        raise Damaged("empty member")
    return out, end


def _at(source: Source, at: int) -> tuple[list[Record], int]:
    if source.read(at, 2) == b"\x1f\x8b":
        return gzip_records(source, at)
    own = plain_record(source, at)
    return [own], at + own.length


def salvage(stream) -> Iterator[Record | Gap]:
    """All records of a file that pass their checks, in order, and the gaps between them."""
    source, at = Source(stream), 0
    while at < source.size:
        try:
            found, end = _at(source, at)
        except Damaged as wrong:
            found, end, start = [], source.size, source.size
            for mark in source.marks(at + 1):
                try:
                    found, end = _at(source, mark)
                except Damaged:
                    continue
                start = mark
                break
            yield Gap(at, start - at, str(wrong))
        yield from found
        at = end


# -- reading ------------------------------------------------------------------------

READ = ("file string, offset long, length long, gap string, record_type string, record_id string, target_uri string, "
        "page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary")
#: Payload bytes of one Arrow batch, about.
BATCH_BYTES = 16 << 20
#: Tasks that read files at most; beyond, a task reads several.
READ_TASKS = 10_000


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,19}", text) else None


def _row(name: str, item: Record | Gap, payloads: bool) -> tuple:
    if isinstance(item, Gap):
        return (name, item.offset, item.length, item.reason, *[None] * 8)
    fields, (head, payload) = item.fields, item.http()
    size, digest = len(payload), None
    if fields["warc-type"] == "revisit":  # the payload is elsewhere
        length = re.search(rb"(?im)^content-length:\s*([0-9]{1,18})\s*$", head)
        size, digest = int(length[1]) if length else None, fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    else:
        digest = hashlib.sha256(payload).hexdigest()
    return (name, item.offset, item.length, None, fields["warc-type"], fields.get("warc-record-id"), fields.get("warc-target-uri"),
            _number(fields.get(PAGE_ID.lower())), _number(fields.get(REFERS_TO.lower())), size, digest,
            payload if payloads and fields["warc-type"] != "revisit" else None)


def read(files: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record and every gap (``gap``: its reason) of the files of a column ``file``; without
    ``payloads`` only their sizes and digests leave the task."""
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, *[pa.int64()] * 3, pa.string(), pa.binary()]
    names = [part.split()[0] for part in READ.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([_text(v) for v in c] if t == pa.string() else c, t)
                                for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for name in given["file"].to_pylist():
                rows, held = [], 0
                with opened(name) as stream:
                    for item in salvage(stream):
                        rows.append(_row(name, item, payloads))
                        held += len(rows[-1][-1] or b"") + 500
                        if held >= BATCH_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    names_only = files.select("file").filter(F.col("file").isNotNull())
    tasks = max(1, min(READ_TASKS, names_only.count()))
    return names_only.repartition(tasks).mapInArrow(run, READ)


def _text(value: str | None) -> str | None:
    """Bytes of a header that are not UTF-8 become replacement characters."""
    return value if value is None or value.isascii() else value.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def gaps(rows: DataFrame) -> DataFrame:
    """``file, offset, length, reason`` of the bytes that no record was read from."""
    return rows.filter(F.col("gap").isNotNull()).select("file", "offset", "length", F.col("gap").alias("reason"))


def pages(rows: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the pages' records."""
    own = rows.filter(F.col("gap").isNull() & F.col("record_type").isin("response", "revisit"))
    return own.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def restored(rows: DataFrame) -> DataFrame:
    """``page_id, target_uri, payload`` with the payloads of revisits taken from their responses
    (null where that was not read): one payload per digest, hot ones joined by broadcast."""
    own = rows.filter(F.col("gap").isNull() & F.col("record_type").isin("response", "revisit"))
    direct = own.filter("record_type = 'response'").select("page_id", "target_uri", "payload")
    again = own.filter("record_type = 'revisit'").select("page_id", "target_uri", F.coalesce("payload_digest", F.lit("")).alias("d"))
    wanted = written(rows.sparkSession, again.groupBy("d").agg(F.count(F.lit(1)).alias("_n")), "warc-wanted")
    found = (own.filter("record_type = 'response'").select(F.col("payload_digest").alias("d"), "payload")
             .join(wanted, "d").groupBy("d").agg(F.first("payload").alias("payload"), F.first("_n").alias("_n")))
    found = written(rows.sparkSession, found, "warc-restored")
    total = wanted.agg(F.sum("_n")).first()[0] or 0
    back = joined(again, found, "d", "_n", total, "left", most=0)
    return direct.unionByName(back.select("page_id", "target_uri", "payload"))


def oracle(least: int = LEAST) -> str:
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= {least} GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM p.page_id THEN NULL ELSE first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d"""
