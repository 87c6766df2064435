"""Token counts: an exact histogram of encoded lengths answers totals, quantiles
and truncated totals for every context limit.

Whole texts are encoded on the executors (``encoding.Encoder``), documents are
counted by length with map-side combining, and suffix sums over the histogram
give, for each length ``L`` that occurs, the documents and tokens at or above it
and what a context limit of ``L`` keeps, truncates and drops.  The suffix sums
are two-level: sums of ranges of ``RANGE`` lengths, then inside each range, so no
task holds the whole histogram, however many lengths occur.

Defined results: null text = empty text = 0 tokens (plus ``extra`` per document,
such as an end token); rows with a null id count; an empty table has an empty
histogram and null quantiles; repeated rows count each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratelens.llm.common import texts
from ratelens.llm.encoding import encoder

RANGE = 1024


def lengths(docs: DataFrame, path: str, extra: int = 0) -> DataFrame:
    """``doc_id, n_tokens`` per row: ids of the whole text, plus ``extra``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path).ids
        for batch in batches:
            n = [len(ids(t)) // 4 + extra for t in texts(batch["text"])]
            yield pa.record_batch([batch["doc_id"].cast(pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """``n_tokens, n_docs`` for every length that occurs."""
    return counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For every length ``n_tokens`` that occurs: ``docs_from``/``tokens_from``
    (documents of at least that length and their tokens), ``docs_below``, and for
    the context limit of that length ``kept_tokens`` (sum of min(length, limit))
    and ``cut_tokens`` (what truncation drops)."""
    h = hist.withColumn("_r", F.floor(F.col("n_tokens") / F.lit(RANGE)))
    h = h.withColumn("_t", F.col("n_docs") * F.col("n_tokens"))
    ranges = h.groupBy("_r").agg(F.sum("n_docs").alias("_rd"), F.sum("_t").alias("_rt"))
    later = ranges.select(F.col("_r").alias("_o"), F.col("_rd").alias("_od"), F.col("_rt").alias("_ot"))
    # at most longest text / RANGE rows on either side
    above = (ranges.join(later, F.col("_o") > F.col("_r"), "left").groupBy("_r")
             .agg(F.coalesce(F.sum("_od"), F.lit(0)).alias("_ad"), F.coalesce(F.sum("_ot"), F.lit(0)).alias("_at")))
    totals = ranges.agg(F.sum("_rd").alias("_n"), F.sum("_rt").alias("_all"))
    own = Window.partitionBy("_r").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = (h.join(above, "_r").crossJoin(F.broadcast(totals))
           .withColumn("docs_from", F.sum("n_docs").over(own) + F.col("_ad"))
           .withColumn("tokens_from", F.sum("_t").over(own) + F.col("_at")))
    kept = F.col("_all") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")
    return out.select("n_tokens", "n_docs", "docs_from", "tokens_from",
                      (F.col("_n") - F.col("docs_from")).alias("docs_below"), kept.alias("kept_tokens"),
                      (F.col("_all") - kept).alias("cut_tokens"))


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """Truncated totals for any context limits: ``limit, docs_over, kept_tokens,
    cut_tokens``; a limit between two lengths follows from the next longer one."""
    spark = sums.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in sorted(set(limits))], "limit long")
    nxt = (sums.join(F.broadcast(wanted), F.col("n_tokens") > F.col("limit"), "right").groupBy("limit")
           .agg(F.max("docs_from").alias("docs_over"), F.max("tokens_from").alias("_over")))
    total = sums.agg(F.coalesce(F.max("tokens_from"), F.lit(0)).alias("_all"))
    return (nxt.crossJoin(F.broadcast(total)).na.fill(0, ["docs_over", "_over"])
            .select("limit", "docs_over",
                    (F.col("_all") - F.col("_over") + F.col("docs_over") * F.col("limit")).alias("kept_tokens"),
                    (F.col("_over") - F.col("docs_over") * F.col("limit")).alias("cut_tokens")))


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Exact length quantiles: ``share, n_tokens`` = the smallest length that at
    least ``share`` of the documents do not exceed."""
    spark = sums.sparkSession
    wanted = spark.createDataFrame([(float(x),) for x in sorted(set(shares))], "share double")
    n = sums.agg(F.max("docs_from").alias("_n"))
    upto = F.col("docs_below") + F.col("n_docs")
    reached = sums.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(wanted)).filter(upto >= F.col("share") * F.col("_n"))
    found = reached.groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
    return wanted.join(found, "share", "left")
