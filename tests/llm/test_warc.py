"""WARC archives: round trip, revisit choice, and salvage after damage."""

from __future__ import annotations

import gzip
import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ratelens.llm import common, warc
from ratelens.operators.skew import HotKeys

SCHEMA = "page_id long, url string, html string"
DATE = "2024-05-01T00:00:00Z"


def plain(rows):
    """What each page's row must be."""
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in rows:
        data, to = (html or "").encode(), first.get(html or "")
        again = len(data) >= 100 and to is not None and to != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(map(repr, out))


def got(frame):
    return sorted(map(repr, map(tuple, frame.collect())))


def make(n=12, **more):
    rng = random.Random(3)
    out = []
    for i in range(n):
        payload = bytes(rng.randrange(256) for _ in range(rng.randrange(50, 400)))
        out.append(warc.page_record(i, f"http://h/{i}", payload, hashlib.sha256(payload).hexdigest(), None, DATE))
    return out


def salvaged(data):
    items = list(warc.salvage(pa.BufferReader(data)))
    return ([int(r.fields["x-page-id"]) for r in items if isinstance(r, warc.Record)],
            [(g.offset, g.length) for g in items if isinstance(g, warc.Gap)])


@pytest.mark.parametrize("gzipped", [True, False])
def test_round_trip_of_odd_pages(spark, tmp_dir, gzipped):
    same = "the same page " * 20
    rows = [(4, "http://a/1", same), (9, "http://a/ \r\nX: y", same), (2, "http://b/é", same), (2, None, same), (None, "u", same),
            (5, None, None), (6, "http://c", ""), (7, "u", "short"), (8, "u", "short"), (3, "v", "\r\n\r\nWARC/1.1\r\n" * 40),
            (11, "v", "é中\x00" * 9000), (None, "w", "only nameless " * 9), (None, "w", "only nameless " * 9), (None, None, None)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns(
        {"digest": F.lit("d"), "refers_to": F.lit(1), "_first": F.lit(1), "_n": F.lit(2), "file": F.lit("f"), "payload": F.lit("p")})
    files = warc.write(pages, f"{tmp_dir}/w", gzip=gzipped, file_bytes=1500)
    read = warc.read(files).cache()
    assert got(warc.pages(read)) == plain(rows)
    assert warc.gaps(read).collect() == []
    assert files.agg(F.sum("n_records")).first()[0] == len(rows) and files.count() > 3
    back = warc.restored(read).select("page_id", F.decode("payload", "utf-8").alias("t")).collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(repr((i, h or "")) for i, _, h in rows)
    assert {r.target_uri for r in read.filter("page_id = 9").collect()} == {"http://a/%20%0D%0AX:%20y"}
    if gzipped:  # what any reader of gzip sees
        name = files.first().file
        with gzip.open(name) as stream:
            assert stream.read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_a_table_equals_the_loop(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert got(warc.pages(warc.read(warc.write(pages), payloads=False))) == plain(rows)


def test_empty_table_and_file(spark, tmp_dir):
    pages = spark.createDataFrame([], SCHEMA)
    files = warc.write(pages)
    assert files.collect() == [] and warc.read(files).collect() == []
    open(f"{tmp_dir}/none.warc", "wb").close()
    assert warc.read(spark.createDataFrame([(f"{tmp_dir}/none.warc",), (None,)], "file string")).collect() == []


def test_a_third_of_the_pages_are_one(spark, monkeypatch):
    """Beyond the broadcast bound the shared digests are split: hot ones by broadcast, others by a shuffle."""
    rows = [(k, "u", "hot page " * 20) for k in range(100)] + [(100 + k, "u", f"page {k // 2} " * 20) for k in range(200)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(6)
    calls = []

    def split(*a, most=0, hot=None):
        calls.append(a)
        return common.joined(*a, most=0, hot=HotKeys(share=0.1, min_rows=1))

    monkeypatch.setattr(warc, "joined", split)
    read = warc.read(warc.write(pages))
    assert got(warc.pages(read)) == plain(rows) and calls
    assert warc.restored(read).filter(F.octet_length("payload") > 0).count() == len(rows)


# -- salvage --------------------------------------------------------------------------

@pytest.mark.parametrize("packed", [warc.member, bytes])
def test_damage_costs_the_records_it_touches(packed):
    parts = [packed(r) for r in make()]
    starts = [sum(map(len, parts[:k])) for k in range(len(parts) + 1)]
    whole = b"".join(parts)
    assert salvaged(whole) == (list(range(12)), [])
    rng = random.Random(5)
    for trial in range(150):
        hit = sorted(rng.sample(range(12), rng.randrange(1, 4)))
        data = bytearray(whole)
        for k in hit:
            at = rng.randrange(starts[k], starts[k + 1])
            data[at] ^= 1 << rng.randrange(8)
        items = list(warc.salvage(pa.BufferReader(bytes(data))))
        ids = [starts.index(r.offset) for r in items if isinstance(r, warc.Record)]
        gaps = [(g.offset, g.length) for g in items if isinstance(g, warc.Gap)]
        # no check covers the header fields of a plain record, so a flipped bit may pass there; it never harms another
        assert set(range(12)) - set(hit) <= set(ids) and ids == sorted(ids)
        assert all(g in {(starts[i], starts[j] - starts[i]) for i in range(12) for j in range(i, 13)} for g in gaps)
        assert sum(g[1] for g in gaps) == sum(len(parts[k]) for k in set(range(12)) - set(ids))


@pytest.mark.parametrize("packed", [warc.member, bytes])
def test_cut_inserted_and_lost_bytes(packed):
    parts = [packed(r) for r in make()]
    size = [len(p) for p in parts]
    whole = b"".join(parts)
    assert salvaged(whole[:-5]) == (list(range(11)), [(sum(size[:11]), size[11] - 5)])
    lost = whole[:sum(size[:3]) + 40] + whole[sum(size[:5]) + 30:]  # the end of 3, all of 4, the start of 5
    assert salvaged(lost) == ([0, 1, 2, *range(6, 12)], [(sum(size[:3]), 40 + size[5] - 30)])
    junk = b"\x1f\x8b\x08junk WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99999999\r\n\r\n" * 9
    odd = b"".join(parts[:2]) + junk + b"".join(parts[2:])
    assert salvaged(odd) == (list(range(12)), [(sum(size[:2]), len(junk))])
    assert salvaged(junk) == ([], [(0, len(junk))])
    assert salvaged(b"") == ([], [])


def test_windows_and_marks_across_their_edges(monkeypatch):
    records = make(40)
    data = b"".join(b"bad" + (warc.member(r) if k % 2 else r) for k, r in enumerate(records))
    for window in (64, 257, 1000):
        monkeypatch.setattr(warc.Source.__init__, "__defaults__", (window,))
        ids, gaps = salvaged(data)
        assert ids == list(range(40)) and [g[1] for g in gaps] == [3] * 40


def test_several_records_in_a_member_and_foreign_digests():
    block = b"hello"
    sha1 = "sha1:" + __import__("base64").b32encode(hashlib.sha1(block).digest()).decode()

    def foreign(digest):
        return (f"WARC/1.0\r\nwarc-type: resource\r\nWARC-Block-Digest: {digest}\r\nX-Page-Id: 7\r\n folded\r\n"
                f"Content-Length: 5\r\n\r\n").encode() + block + b"\r\n\r\n"
    good = foreign(sha1)
    items = list(warc.salvage(pa.BufferReader(warc.member(good * 3) + good + foreign("blake9:zz"))))
    assert [r.block for r in items] == [block] * 5 and items[0].fields["x-page-id"] == "7 folded"
    bad = list(warc.salvage(pa.BufferReader(foreign(sha1.replace("sha1:", "sha1:A")) + good)))
    assert [type(x).__name__ for x in bad] == ["Gap", "Record"] and bad[0].reason == "block digest"


def test_gaps_are_logged_and_later_records_read(spark, tmp_dir):
    pages = spark.createDataFrame([(k, f"u{k}", f"page {k} " * 30) for k in range(30)], SCHEMA).coalesce(1)
    name = warc.write(pages, f"{tmp_dir}/w").first().file
    rows = warc.read(spark.createDataFrame([(name,)], "file string")).collect()
    at = next(r.offset for r in rows if r.page_id == 11)
    data = bytearray(open(name, "rb").read())
    data[at + 60:at + 70] = b"0123456789"
    with open(f"{tmp_dir}/damaged.warc.gz", "wb") as out:
        out.write(data)
    read = warc.read(spark.createDataFrame([(f"{tmp_dir}/damaged.warc.gz",)], "file string"))
    assert sorted(r.page_id for r in warc.pages(read).collect()) == [k for k in range(30) if k != 11]
    gap, = warc.gaps(read).collect()
    assert (gap.offset, gap.length) == (at, next(r.length for r in rows if r.page_id == 11)) and gap.reason
