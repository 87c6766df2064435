"""Text features as relational plans.

Vocabulary fitting is an exploded token count (partial aggregate) plus a
bounded top-k.  Tokenising and padding are built-in array expressions; only the
token -> id lookup runs in Arrow (``mapInArrow``, vectorised ``index_in``)
against the broadcast vocabulary (bounded by ``num_words``): no join and no
shuffle of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.operators.stopwords import ENGLISH

# Characters a word-sequence tokenizer treats as separators
# (the usual text-preprocessing default), in their natural order.
FILTER_CHARS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'
# Reserved ids.
PAD_ID = 0
OOV_ID = 1
OOV_TOKEN = "<OOV>"
DEFAULT_NUM_WORDS = 20000
DEFAULT_MAX_LENGTH = 200


def _regex_class(chars: str) -> str:
    out = []
    for ch in chars:
        if ch in "\\[]^-":
            out.append("\\" + ch)
        elif ch == "\t":
            out.append("\\t")
        elif ch == "\n":
            out.append("\\n")
        else:
            out.append(ch)
    return "[" + "".join(out) + "]"


FILTER_REGEX = _regex_class(FILTER_CHARS)


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def word_sequence(col: str | Column) -> Column:
    """lower-case, separators -> space, split on space, drop empty words."""
    spaced = F.regexp_replace(F.lower(_c(col)), FILTER_REGEX, " ")
    return F.filter(F.split(spaced, " "), lambda t: t != F.lit(""))


def stop_words() -> tuple[str, ...]:
    """Spark ML's default English stop words (see ``stopwords.py``)."""
    return tuple(ENGLISH.split())


def without_stop_words(arr: str | Column, words: tuple[str, ...] | None = None) -> Column:
    stop = F.array(*[F.lit(w) for w in (words or stop_words())])
    return F.filter(_c(arr), lambda t: ~F.array_contains(stop, t))


#: Buckets of the hashed term frequency.
NUM_BUCKETS = 10000


def term_bucket(term: str | Column, buckets: int = NUM_BUCKETS) -> Column:
    """Bucket of a term by the first 52 bits of its MD5: any engine computes the same."""
    return F.pmod(F.conv(F.substring(F.md5(_c(term).cast("binary")), 1, 13), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def _tokens(text: str) -> Column:
    """Lower case, split at white space (trailing empty tokens fall away)."""
    return F.split(F.regexp_replace(F.lower(_c(text)), "\\s+$", ""), "\\s")


def _terms(df: DataFrame, key: str, text: str, distinct: bool = False) -> DataFrame:
    """``key, term`` per token (``distinct``: per different token of a row), without stop words.

    The stop words are looked up in a set after the split into rows: a filter inside the
    token array would compare every token with every stop word."""
    tokens = F.array_distinct(_tokens(text)) if distinct else _tokens(text)
    return (df.filter(F.col(text).isNotNull()).select(key, F.explode(tokens).alias("term"))
            .filter(~F.col("term").isin(*stop_words())))


def hashed_tfidf(df: DataFrame, key: str, text: str, buckets: int = NUM_BUCKETS, digits: int = 6) -> DataFrame:
    """Sparse document-term table ``key, bucket, tf, weight``: hashed term frequencies and
    ``tf * ln((N + 1) / (df + 1))``, df = documents that have the bucket.

    Tokens are combined per (document, bucket) before the shuffle; document frequencies
    are at most ``buckets`` rows, so their join is a broadcast of bounded size.  A
    very long document's tokens are spread over its buckets."""
    from ratelens.session import RoundStore
    tf = (_terms(df, key, text).groupBy(key, term_bucket("term", buckets).alias("bucket"))
          .agg(F.count(F.lit(1)).alias("tf")))
    tf = RoundStore(df.sparkSession, "hashed-tf").put(tf, "tf")
    n_docs = df.filter(F.col(text).isNotNull()).agg(F.count(F.lit(1))).scalar()
    dfreq = tf.groupBy("bucket").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((n_docs + F.lit(1)).cast("double") / (F.col("df") + F.lit(1)).cast("double"))
    return (tf.join(F.broadcast(dfreq), "bucket")
            .select(key, "bucket", "tf", F.round(F.col("tf") * idf, digits).alias("weight")))


def bucket_collisions(df: DataFrame, key: str, text: str, buckets: int = NUM_BUCKETS) -> DataFrame:
    """``bucket, n_terms, n_docs, n_tokens``: how many terms share a bucket, and its use.

    Tokens are counted per term before the shuffle, and a term's bucket is computed once per task;
    for the documents, only (bucket, document) pairs are shuffled, one per bucket of a text. A frequent
    term or a long document never fills one task."""
    counted = _terms(df, key, text).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    terms = (counted.groupBy(term_bucket("term", buckets).alias("bucket"))
             .agg(F.count(F.lit(1)).alias("n_terms"), F.sum("n").alias("n_tokens")))
    pairs = _terms(df, key, text, distinct=True).select(term_bucket("term", buckets).alias("_b"), key).distinct()
    docs = pairs.groupBy("_b").agg(F.count(F.lit(1)).alias("n_docs"))
    return terms.join(docs, F.col("bucket") == F.col("_b")).select("bucket", "n_terms", "n_docs", "n_tokens")


def fit_vocabulary(df: DataFrame, text: str, num_words: int = DEFAULT_NUM_WORDS) -> DataFrame:
    """Rank words by frequency, ties by the word itself.  Returns ``word, n,
    id`` with ids from 2 (0 = padding, 1 = out of vocabulary), only ids below
    ``num_words``.

    The count is a hash aggregate with map-side combining; the ranking runs on
    the ``num_words`` survivors of a ``TakeOrderedAndProject`` (bounded).
    """
    from pyspark.sql import Window
    counted = (df.select(F.explode(word_sequence(text)).alias("word"))
               .groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    keep = max(num_words - 2, 0)
    top = counted.orderBy(F.col("n").desc(), F.col("word").asc()).limit(keep)
    w = Window.orderBy(F.col("n").desc(), F.col("word").asc())
    return top.select("word", "n", (F.row_number().over(w) + F.lit(1)).cast("int").alias("id"))


def _vocabulary_arrays(vocab: DataFrame, num_words: int):
    """The fitted vocabulary on the driver: bounded by ``num_words`` (checked)."""
    rows = vocab.select("word", "id").limit(num_words + 1).collect()
    if len(rows) > num_words:
        raise ValueError(f"vocabulary has more than {num_words} words")
    return [r["word"] for r in rows], [int(r["id"]) for r in rows]


def encode_tokens(df: DataFrame, tokens: str, vocab: DataFrame, out: str = "ids",
                  num_words: int = DEFAULT_NUM_WORDS) -> DataFrame:
    """Replace the token-array column ``tokens`` by an id-array column ``out``.

    ``mapInArrow``: each Arrow batch's token lists are flattened and looked up
    in one vectorised ``index_in`` against the broadcast vocabulary, then
    re-wrapped with the original offsets.  No Python objects per token, no
    join, no shuffle; partitioning is preserved.
    """
    import pyarrow as pa
    bc = vocab.sparkSession.sparkContext.broadcast(_vocabulary_arrays(vocab, num_words))
    fields = [f for f in df.schema.fields if f.name != tokens]
    schema = T.StructType([*fields, T.StructField(out, T.ArrayType(T.IntegerType()), True)])
    names = [f.name for f in fields]

    def run(batches):
        import pyarrow.compute as pc
        words, ids = bc.value
        value_set = pa.array(words, pa.string())
        id_arr = pa.array(ids, pa.int32())
        for b in batches:
            col = b.column(tokens)
            if isinstance(col, pa.ChunkedArray):
                col = col.combine_chunks()
            flat = col.flatten()
            idx = pc.index_in(flat, value_set=value_set)
            mapped = pc.fill_null(pc.take(id_arr, idx), pa.scalar(OOV_ID, pa.int32()))
            offsets = pc.subtract(col.offsets, col.offsets[0])
            enc = pa.ListArray.from_arrays(offsets, mapped, mask=col.is_null())
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [enc], names=names + [out])

    return df.mapInArrow(run, schema)


def pad_truncate(ids: str | Column, length: int = DEFAULT_MAX_LENGTH, value: int = PAD_ID) -> Column:
    """Keep the first ``length`` ids and pad at the end; always ``length`` long."""
    return F.slice(F.concat(_c(ids), F.array_repeat(F.lit(value), length)), 1, length)


def encode_documents(docs: DataFrame, text: str, vocab: DataFrame, keep: list[str],
                     length: int = DEFAULT_MAX_LENGTH) -> DataFrame:
    """Whole-text encoding, then pad/truncate: ``keep..., n_tokens, n_oov, ids``."""
    enc = encode_tokens(docs.select(*keep, word_sequence(text).alias("_tokens")), "_tokens", vocab, "_ids")
    return enc.select(
        *keep,
        F.size("_ids").alias("n_tokens"),
        F.size(F.filter("_ids", lambda i: i == F.lit(OOV_ID))).alias("n_oov"),
        pad_truncate("_ids", length).alias("ids"),
    )


def save_encoder(vocab: DataFrame, path: str, max_length: int = DEFAULT_MAX_LENGTH,
                 num_words: int = DEFAULT_NUM_WORDS) -> None:
    """Vocabulary (parquet) and its settings (one-row JSON) beside a model."""
    vocab.select("word", "n", "id").write.mode("overwrite").parquet(f"{path}/vocabulary")
    spark = vocab.sparkSession
    spark.createDataFrame([(int(max_length), int(num_words), OOV_TOKEN)],
                          "max_length int, num_words int, oov_token string") \
        .coalesce(1).write.mode("overwrite").json(f"{path}/config")


def load_encoder(spark, path: str) -> tuple[DataFrame, dict]:
    vocab = spark.read.parquet(f"{path}/vocabulary")
    cfg = spark.read.schema("max_length int, num_words int, oov_token string").json(f"{path}/config").first()
    return vocab, cfg.asDict()
