"""Filter interaction audit against a plain loop over rows and orders."""

from __future__ import annotations

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from llm_fixtures import no_docs, no_labels, odd_docs, some_labels  # noqa: F401
from ratelens.llm import filter_audit
from ratelens.operators.skew import HotKeys


def plain(docs, labels):
    """(part, order, step) -> the seven counts, by applying the filters to rows."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    first, rows = {}, []
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {c for c, bad in (
            ("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)),
            ("C", 100 * len(re.findall("[A-Z]", text)) > 2 * len(text)), ("D", bool(re.search(r"[#$%&*|]", text))),
            ("E", i is not None and i > first[text])) if bad}
        rows.append((source or "", i, fails))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            alive = own
            for step, c in enumerate(order, 1):
                gone = [r for r in alive if c in r[2]]
                failing = sum(c in r[2] for r in own)
                alive = [r for r in alive if c not in r[2]]
                shapley[c] += len(gone)
                out[part, "".join(order), step] = [
                    len(alive), len(gone), failing - len(gone), sum(r[2] == {c} for r in own),
                    sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


def got(frame):
    rows = frame.collect()
    out = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
           for r in rows}
    assert len(out) == len(rows)
    return out


def plain_of(docs, labels):
    return plain([tuple(r) for r in docs.select("doc_id", "text", "source").collect()],
                 [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])


def test_a_table_equals_the_loop(spark):
    docs, labels = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "labels"))
    assert got(filter_audit.audit(docs, labels)) == plain_of(docs, labels)


def test_odd_rows_equal_the_loop(spark, odd_docs, some_labels):  # noqa: F811
    # clashing names, one label given twice, a part that is null or empty
    docs = odd_docs.withColumns({"h": F.lit("x"), "n": F.lit(0), "bits": F.lit(9), "part": F.lit("p"), "_h": F.lit(1),
                                 "salt": F.lit(None).cast("int"), "words": F.lit("w"), "good": F.lit(5)})
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, "").otherwise("z"))
    labels = some_labels.unionByName(spark.createDataFrame([(1, 0, 1), (2, 1, 1)], some_labels.schema))
    labels = labels.withColumns({"n": F.lit(1), "part": F.lit("q"), "good": F.lit(3)})
    assert got(filter_audit.audit(docs, labels)) == plain_of(docs, labels)


def test_empty_tables(spark, odd_docs, no_docs, no_labels, some_labels):  # noqa: F811
    assert filter_audit.audit(no_docs, some_labels).collect() == []
    assert got(filter_audit.audit(odd_docs, no_labels)) == plain_of(odd_docs, no_labels)


@pytest.mark.parametrize("ids", ["many", "one", "none"])
def test_a_third_of_the_rows_share_text_and_id(spark, ids, monkeypatch):
    """A hot text is spread over salted tasks and each row still counts."""
    key = {"many": lambda k: k, "one": lambda k: 7, "none": lambda k: None}[ids]
    rows = [(key(k), "the same text", "s") for k in range(400)] + [(1000 + k, f"text {k % 300}", "s") for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    labels = spark.createDataFrame([(7, 1, 1), (1100, 1, 0)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(filter_audit, "CHUNK", 16)
    light = filter_audit.own_failures(docs)
    found = filter_audit.copies(docs, light, chunk=16)
    assert found.count() == (399 if ids == "many" else 0) + 500
    assert got(filter_audit.audit(docs, labels)) == plain(rows, [(7, 1, 1), (1100, 1, 0)])


def test_shuffled_groups_and_hot_ids_give_the_same(spark, monkeypatch):
    """Beyond the broadcast bound the groups are joined by a shuffle; a hot id's labels by broadcast."""
    rows = [(7, f"other text {k}", "s") for k in range(60)] + [(k, f"t {k // 2}", "u") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(7, 1, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    rows += [(200 + k, "a hot text", "u") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    real = filter_audit.joined
    monkeypatch.setattr(filter_audit, "joined", lambda *a: real(*a, most=0, hot=HotKeys(share=0.1, min_rows=1)))
    combos = filter_audit.combinations(filter_audit.failures(docs), labels, HotKeys(share=0.1, min_rows=1))
    assert got(filter_audit.interactions(combos, "ABCDE")) == plain(rows, [(7, 1, 1), (9, 0, 1)])


def test_equal_hashes_of_different_texts_are_no_copies(spark, monkeypatch):
    """The text decides, not its hash."""
    rows = [(k, t, "s") for k, t in enumerate(["a", "b", "a", "c", "b"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    real = filter_audit._texts
    monkeypatch.setattr(filter_audit, "_texts", lambda d, part: real(d, part).withColumn("h", F.lit(5).cast("long")))
    found = filter_audit.copies(docs, filter_audit.own_failures(docs), chunk=2)
    assert sorted(r.doc_id for r in found.collect()) == [2, 4]


def test_own_conditions(spark):
    docs = spark.createDataFrame([(1, "x y", "s"), (2, "x y", "s"), (3, "z", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = filter_audit.audit(docs, labels, {"S": lambda: F.size("words") < 2}).collect()
    assert sorted((r.filter_order, r.step, r.kept, r.removed, r.shapley) for r in rows) == [
        ("ES", 1, 2, 1, 2), ("ES", 2, 1, 1, 2), ("SE", 1, 2, 1, 2), ("SE", 2, 1, 1, 2)]
