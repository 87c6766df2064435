"""Filter interaction audit: what each filter removes, in every order of the filters.

1. One scan gives every row the bits of the filters that its own text fails, and
   a 64-bit hash of the text.
2. The copy filter is an existential self-join: rows are left-semi joined with the
   table's texts on hash, exact text and a smaller ``doc_id``. Only hashes that
   several ids share take part; the joined side holds each such text once, with
   its least id (combined before the shuffle), and both sides are salted by
   the size of the hash's group, so a text copied a million times is spread out.
3. The rows it finds are united with the other failures by ``(part, doc_id,
   hash)``, bits are combined, and bit combinations counted per part.
4. A part has at most ``2**k`` combinations. For every set S of filters the rows
   that survive S are summed from them; each column of each order and step is
   a difference of two such sums, and the Shapley sum a weighted one (a set S
   stands before filter f in ``|S|! (k - 1 - |S|)!`` orders).

Memory: no task holds more than a sort or hash buffer; the driver sees one count
of rows and the list of hot ids (fewer than 100).

Defined results: a null text is empty; a null ``part`` is the empty string; rows
without an id take part, are no one's copy and have no labels; rows that repeat
an id and a text are no copies of each other and each counts; contradicting
labels of an id count as their maximum; extra columns are ignored; an
empty table has no part, so no row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import joined, written
from ratelens.operators.skew import HotKeys, hot_keys, split_join

#: Rows of one hash in one task of the self-join.
CHUNK = 1024

WORD_BREAK = "[ \\t\\n\\x0B\\f\\r]+"


def text_counts(text: Column) -> dict[str, Column]:
    """What the conditions look at: words, distinct words, A-Z and code points."""
    words = F.array_remove(F.split(text, WORD_BREAK), "")
    return {"words": words, "upper": F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", "")),
            "points": F.length(text)}


#: Conditions of failure on the columns ``text, words, upper, points``.
CONDITIONS: dict[str, Callable[[], Column]] = {
    "A": lambda: F.size("words") < 200,
    "B": lambda: F.lit(100) * F.size(F.array_distinct("words")) < F.lit(50) * F.size("words"),
    "C": lambda: F.lit(100) * F.col("upper") > F.lit(2) * F.col("points"),
    "D": lambda: F.col("text").rlike("[#$%&*|]"),
}
#: The name of the copy filter.
COPY = "E"


def _texts(docs: DataFrame, part: str) -> DataFrame:
    """``part, doc_id, text, h``: the columns the audit reads, without nulls in part and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))


def own_failures(docs: DataFrame, conditions: Mapping[str, Callable[[], Column]] = CONDITIONS,
                 part: str = "source") -> DataFrame:
    """Per row of ``docs``: ``part, doc_id, h, bits``, bit i = failure of the i-th condition."""
    counted = _texts(docs, part).withColumns(text_counts(F.col("text")))
    bits = F.lit(0)
    for i, condition in enumerate(conditions.values()):
        bits = bits + F.when(condition(), F.lit(1 << i)).otherwise(F.lit(0))
    return counted.select("part", "doc_id", "h", bits.alias("bits"))


def copies(docs: DataFrame, rows: DataFrame, part: str = "source", chunk: int = CHUNK) -> DataFrame:
    """``part, doc_id, h`` of the rows whose text a smaller id has as well.

    ``rows`` are the rows of ``docs`` by ``doc_id, h``. A hash with one id cannot hold a
    copy; for the others the text itself decides."""
    spark = docs.sparkSession
    named = F.col("doc_id").isNotNull()
    groups = (rows.filter(named).groupBy("h")
              .agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi"), F.count(F.lit(1)).alias("_n"))
              .filter("_lo < _hi").select("h", "_lo", "_n", F.ceil(F.col("_n") / chunk).cast("int").alias("_salts")))
    groups = written(spark, groups, "audit-groups")
    shared = joined(_texts(docs, part).filter(named), groups, "h", "_n", rows.count())
    firsts = (shared.groupBy("h", "text").agg(F.min("doc_id").alias("_first"), F.max("_salts").alias("_salts"))
              .select(F.col("h").alias("_h"), F.col("text").alias("_text"), "_first",
                      F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt")))
    # rows that repeat id and text are spread by the partition they were read in
    later = (shared.filter(F.col("doc_id") > F.col("_lo"))
             .withColumn("salt", F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.col("_salts")).cast("int"))
             .select("part", "doc_id", "h", "text", "salt"))
    same = ((F.col("h") == F.col("_h")) & (F.col("salt") == F.col("_salt")) & (F.col("text") == F.col("_text"))
            & (F.col("_first") < F.col("doc_id")))
    return later.join(firsts, same, "left_semi").select("part", "doc_id", "h")


def failures(docs: DataFrame, conditions: Mapping[str, Callable[[], Column]] = CONDITIONS,
             part: str = "source") -> DataFrame:
    """``part, doc_id, h, bits, n``: all failures of the n rows that share these; the copy
    filter has the bit after the conditions'. (A 64-bit hash tells texts of one id
    apart; copies themselves were found on whole texts.)"""
    rows = written(docs.sparkSession, own_failures(docs, conditions, part), "audit-rows")
    found = copies(docs, rows, part).withColumn("bits", F.lit(1 << len(conditions)))
    every = (rows.withColumn("n", F.lit(1).cast("long"))
             .unionByName(found.withColumn("n", F.lit(0).cast("long"))))
    return every.groupBy("part", "doc_id", "h").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))


def combinations(failed: DataFrame, labels: DataFrame, hot: HotKeys = HotKeys()) -> DataFrame:
    """``part, bits, n, good, toxic``: rows per combination; of those that fail
    something, how many are labelled of quality and toxic."""
    failed = written(failed.sparkSession, failed, "audit-failures")
    named = failed.filter("bits <> 0 AND doc_id IS NOT NULL")
    marks = (labels.filter(F.col("doc_id").isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1)))
             .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max(F.coalesce((F.col("quality") == 1).cast("long"), F.lit(0))).alias("good"),
                  F.max(F.coalesce((F.col("toxic") == 1).cast("long"), F.lit(0))).alias("toxic")))
    # an id may hold a third of all rows, each with another text
    per_id = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    often = hot_keys(per_id, "doc_id", "_n", named.agg(F.count(F.lit(1))).scalar(), hot)
    marked = split_join(named, marks, "doc_id", often)
    zero = F.lit(0).cast("long")
    counted = (failed.groupBy("part", "bits").agg(F.sum("n").alias("n")).withColumns({"good": zero, "toxic": zero})
               .unionByName(marked.groupBy("part", "bits").agg(F.sum(F.col("n") * F.col("good")).alias("good"),
                                                               F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
                            .withColumn("n", zero)))
    return counted.groupBy("part", "bits").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def interactions(combos: DataFrame, names: str) -> DataFrame:
    """All orders and steps of the filters ``names`` (bit i: the i-th letter) from the
    counts of their combinations, a row per part, order and step."""
    k = len(names)
    every = (1 << k) - 1
    alive = F.col("bits").bitwiseAND(F.col("_s")) == 0
    sums = (combos.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(every))))
            .groupBy("part", "_s").agg(*(F.sum(F.when(alive, F.col(c)).otherwise(F.lit(0))).alias(c)
                                         for c in ("n", "good", "toxic"))))
    # at most 2**k small rows of a part
    whole = sums.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("_s", "n", "good", "toxic"))).alias("left"))

    def left(mask, what: str = "n") -> Column:
        at = mask + 1 if isinstance(mask, int) else mask + F.lit(1)
        return F.element_at("left", at)[what]

    def shapley(f: int) -> Column:
        total = F.lit(0).cast("long")
        for s in range(1 << k):
            if not s >> f & 1:
                before = s.bit_count()
                ways = factorial(before) * factorial(k - 1 - before)
                total = total + F.lit(ways) * (left(s) - left(s | 1 << f))
        return total

    of = whole.select("part", "left", F.array(*(shapley(f) for f in range(k))).alias("_shapley"))
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(names))))
    steps = (of.withColumn("filter_order", orders)
             .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
             .withColumn("_f", F.instr(F.lit(names), F.substring("filter_order", F.col("step"), F.lit(1))) - 1))
    before = sum((F.when(F.instr("filter_order", c) < F.col("step"), F.lit(1 << i)).otherwise(F.lit(0))
                  for i, c in enumerate(names)), F.lit(0))
    steps = steps.withColumn("_bit", F.element_at(F.array(*(F.lit(1 << i) for i in range(k))), F.col("_f") + 1)).withColumn("_before", before)
    then = F.col("_before") + F.col("_bit")
    removed = left(F.col("_before")) - left(then)
    rest = F.lit(every) - F.col("_bit")
    return steps.select(
        "part", "filter_order", "step",
        left(then).alias("kept"), removed.alias("removed"),
        (left(0) - left(F.col("_bit")) - removed).alias("redundant"),
        (left(rest) - left(every)).alias("unique_fails"),
        (left(F.col("_before"), "good") - left(then, "good")).alias("good_lost"),
        (left(F.col("_before"), "toxic") - left(then, "toxic")).alias("toxic_lost"),
        F.element_at("_shapley", F.col("_f") + 1).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, conditions: Mapping[str, Callable[[], Column]] = CONDITIONS,
          part: str = "source") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley`` of the conditions and the copy filter."""
    combos = written(docs.sparkSession, combinations(failures(docs, conditions, part), labels), "audit-combinations")
    return interactions(combos, "".join(conditions) + COPY)


def oracle() -> str:
    """DuckDB: bits per row, every permutation, counts by brute force over the rows' combinations."""
    return r"""
WITH t AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
        + CASE WHEN 100 * (length(t.text) - length(regexp_replace(t.text, '[A-Z]', '', 'g'))) > 2 * length(t.text) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(t.text, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN t.doc_id > first THEN 16 ELSE 0 END AS bits
      FROM t JOIN firsts ON t.text = firsts.text LEFT JOIN l ON t.doc_id = l.doc_id),
c AS (SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, bits),
x(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
      AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
      FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, bit,
        sum(CASE WHEN c.bits & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN c.bits & before = 0 AND c.bits & bit <> 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN c.bits & before <> 0 AND c.bits & bit <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN c.bits = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN c.bits & before = 0 AND c.bits & bit <> 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN c.bits & before = 0 AND c.bits & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r"""
