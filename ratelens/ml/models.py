"""Spark ML models of the review tasks.

- star classifier (Q71): TF-IDF + multinomial logistic regression
- sentiment classifier (Q7 / Q11c): TF-IDF + binary logistic regression,
  score = P(positive); class weights balance a skewed label
- fans regression (Q10): vector assembler + random forest

Training data is split by key hash (``operators.sampling``), so a saved model
is never evaluated on its own training rows after a re-read.  Texts are
tokenised and hashed once per task into a written table; features are persisted
(memory and disk) for the iterative fit and released afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, StopWordsRemover, Tokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ratelens.operators.sampling import hash_split
from ratelens.session import RoundStore, path_exists

# Model settings of the review tasks.
NUM_HASH_FEATURES = 10000
STAR_LR = dict(maxIter=100, regParam=0.001)
FOREST = dict(numTrees=50, maxDepth=25, seed=42)


def text_stages(text: str = "text") -> list:
    """Tokenizer -> stop words -> hashed term frequency -> IDF."""
    return [
        Tokenizer(inputCol=text, outputCol="words"),
        StopWordsRemover(inputCol="words", outputCol="filtered"),
        HashingTF(inputCol="filtered", outputCol="rawFeatures", numFeatures=NUM_HASH_FEATURES),
        IDF(inputCol="rawFeatures", outputCol="features"),
    ]


def _murmur3() -> Callable[[pa.Array], np.ndarray]:
    """The hash of ``HashingTF``; made here, so that it travels with a task whatever its worker can import."""
    def murmur3(terms: pa.Array, seed: int = 42) -> np.ndarray:
        """32-bit Murmur3 of the UTF-8 bytes of every string."""
        _, offsets, data = terms.cast(pa.large_binary()).buffers()
        start = np.frombuffer(offsets, np.int64)[terms.offset:][:len(terms) + 1]
        size, start = np.diff(start), start[:-1]
        byte = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)).astype(np.uint32)

        def rotated(x: np.ndarray, by: int) -> np.ndarray:
            return (x << np.uint32(by)) | (x >> np.uint32(32 - by))

        def scrambled(k: np.ndarray) -> np.ndarray:
            return rotated(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)

        h = np.full(len(terms), seed, np.uint32)
        rows, block = np.flatnonzero(size >= 4), 0
        while len(rows):
            at = start[rows] + 4 * block
            word = byte[at] | byte[at + 1] << np.uint32(8) | byte[at + 2] << np.uint32(16) | byte[at + 3] << np.uint32(24)
            h[rows] = rotated(h[rows] ^ scrambled(word), 13) * np.uint32(5) + np.uint32(0xE6546B64)
            block += 1
            rows = rows[size[rows] >= 4 * block + 4]
        tail = np.zeros(len(terms), np.uint32)
        for k in range(3):
            more = np.flatnonzero(size % 4 > k)
            tail[more] |= byte[(start + size - size % 4)[more] + k] << np.uint32(8 * k)
        h ^= scrambled(tail)
        h ^= size.astype(np.uint32)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return h ^ (h >> np.uint32(16))

    return murmur3


def hashed_terms(stages: Sequence, df: DataFrame) -> DataFrame:
    """``df`` with the column ``rawFeatures`` that the text ``stages`` (tokenizer, stop words, hashed
    term frequency) give, texts not null.  Tokens go through Arrow: stop words and hashes are
    looked up and computed once per different token of a batch, and counted in one sort."""
    tokenizer, remover, tf = stages
    words, out, buckets = tokenizer.getOutputCol(), tf.getOutputCol(), tf.getNumFeatures()
    stop = [w.lower() for w in remover.getStopWords()]
    names, murmur3 = list(df.columns), _murmur3()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dropped = pa.array(stop, pa.string())
        for batch in batches:
            n, tokens = batch.num_rows, batch.column(words)
            if not n:
                continue
            coded = tokens.flatten().dictionary_encode()
            terms, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
            # HashingTF: the signed hash modulo the buckets, not negative
            bucket = murmur3(terms).view(np.int32).astype(np.int64) % buckets
            keep = ~pc.is_in(terms, value_set=dropped).to_numpy(zero_copy_only=False)[at]
            row = np.repeat(np.arange(n), np.diff(tokens.offsets.to_numpy()))
            cell, count = np.unique(row[keep] * buckets + bucket[at[keep]], return_counts=True)
            offsets = pa.array(np.searchsorted(cell, np.arange(n + 1) * buckets), pa.int32())
            vector = pa.StructArray.from_arrays(
                [pa.array(np.zeros(n), pa.int8()), pa.array(np.full(n, buckets), pa.int32()),
                 pa.ListArray.from_arrays(offsets, pa.array(cell % buckets, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(count, pa.float64()))], ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), vector], names=[*names, out])

    schema = StructType([*df.schema.fields, StructField(out, VectorUDT())])
    return tokenizer.transform(df).select(*names, words).mapInArrow(run, schema)


def term_counts(df: DataFrame, text: str, keep: Sequence[str]) -> tuple[list, DataFrame]:
    """Tokenised and hashed rows, ``keep`` columns and ``rawFeatures``, written once
    to the shared folder: every fit and evaluation on them scans that table
    instead of reading and tokenising the texts again.  Returns the text stages
    (transformers) and the table."""
    spark = df.sparkSession
    stages = text_stages(text)[:-1]
    out = hashed_terms(stages, df.filter(F.col(text).isNotNull()).select(*dict.fromkeys([*keep, text])))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = out.select(*keep, "rawFeatures").repartition(parts)
    return stages, RoundStore(spark, "term-counts").put(out, "tf")


def fit_on_counts(stages: list, counts: DataFrame, lr: LogisticRegression) -> PipelineModel:
    """IDF and ``lr`` fitted on a ``term_counts`` table; the whole pipeline model."""
    idf = text_stages()[-1].fit(counts)
    data = idf.transform(counts).drop("rawFeatures").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return PipelineModel([*stages, idf, lr.fit(data)])
    finally:
        data.unpersist()


def transform_counts(model: PipelineModel, counts: DataFrame) -> DataFrame:
    """The model's IDF and classifier on a ``term_counts`` table."""
    for stage in model.stages[-2:]:
        counts = stage.transform(counts)
    return counts


def star_lr(label: str = "stars", max_iter: int = STAR_LR["maxIter"], reg: float = STAR_LR["regParam"]) -> LogisticRegression:
    return LogisticRegression(maxIter=max_iter, regParam=reg, labelCol=label, featuresCol="features")


def fit_star_classifier(train: DataFrame, text: str = "text", label: str = "stars", **settings) -> PipelineModel:
    stages, counts = term_counts(train, text, [label])
    return fit_on_counts(stages, counts, star_lr(label, **settings))


MAX_CLASSES = 1000


def class_weight(df: DataFrame, label: str, max_classes: int = MAX_CLASSES):
    """Balanced weight n / (k * n_label) as a column expression.

    The per-class counts (one aggregate job) come to the driver only after the
    class count is checked against ``max_classes``; the weights then travel as
    literals in the plan: no join, no broadcast table."""
    counts = (df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(max_classes + 1).collect())
    if len(counts) > max_classes:
        raise ValueError(f"more than {max_classes} classes in {label!r}")
    total = sum(r["n"] for r in counts)
    expr = F.lit(1.0)
    for r in counts:
        expr = F.when(F.col(label) == F.lit(r[label]), F.lit(total / (len(counts) * r["n"]))).otherwise(expr)
    return expr


def sentiment_lr(label: str, balanced: bool, max_iter: int = 100, reg: float = 0.01) -> LogisticRegression:
    return LogisticRegression(maxIter=max_iter, regParam=reg, labelCol=label, featuresCol="features",
                              **({"weightCol": "weight"} if balanced else {}))


def fit_sentiment_on_counts(stages: list, counts: DataFrame, label: str = "label", max_iter: int = 100,
                            reg: float = 0.01, balance: bool = True) -> PipelineModel:
    """Binary classifier on a ``term_counts`` table (weights: one scan of its label column)."""
    if balance:
        counts = counts.withColumn("weight", class_weight(counts, label))
    return fit_on_counts(stages, counts, sentiment_lr(label, balance, max_iter, reg))


def fit_sentiment_classifier(train: DataFrame, text: str = "text", label: str = "label", **settings) -> PipelineModel:
    stages, counts = term_counts(train, text, [label])
    return fit_sentiment_on_counts(stages, counts, label, **settings)


def sentiment_scores(model: PipelineModel, df: DataFrame, threshold: float = 0.5, counted: bool = False,
                     batched: bool = False) -> DataFrame:
    """Adds ``sentiment_score`` = P(positive) and ``predicted_sentiment`` (``counted``:
    ``df`` is a ``term_counts`` table; ``batched``: its terms are hashed by ``hashed_terms``, else the
    model's own stages run)."""
    if counted or batched:
        scored = transform_counts(model, df if counted else hashed_terms(model.stages[:-2], df))
    else:
        scored = model.transform(df)
    score = vector_to_array("probability")[1]
    keep = [c for c in df.columns if c != "rawFeatures"]
    return scored.select(*keep, score.alias("sentiment_score"),
                         (score > F.lit(threshold)).cast("int").alias("predicted_sentiment"))


def fit_fans_forest(train: DataFrame, features: Sequence[str], label: str = "label",
                    num_trees: int = FOREST["numTrees"], max_depth: int = FOREST["maxDepth"],
                    seed: int = FOREST["seed"]) -> PipelineModel:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    rf = RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=num_trees,
                               maxDepth=max_depth, seed=seed)
    data = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return Pipeline(stages=[assembler, rf]).fit(data)
    finally:
        data.unpersist()


def feature_importances(spark: SparkSession, model: PipelineModel, names: Sequence[str]) -> DataFrame:
    """``feature, importance`` (one row per input feature: bounded)."""
    forest = model.stages[-1]
    values = forest.featureImportances.toArray()
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "feature string, importance double")


def objective_history(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """``iteration, loss`` of the logistic regression fit (training curve)."""
    lr = model.stages[-1]
    hist = lr.summary.objectiveHistory if lr.hasSummary else []
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(hist)], "iteration int, loss double")


HISTORY = ("step int, reg_param double, max_iter int, train_loss double, train_accuracy double, "
           "val_loss double, val_accuracy double, kept boolean, best boolean")


def loss_and_accuracy(scored: DataFrame, label: str) -> tuple[float, float]:
    """Mean log-loss and accuracy of a scored table in one aggregate; (inf, 0) without rows."""
    p = vector_to_array("probability")[F.col(label).cast("int")]
    row = scored.agg(F.avg(-F.log(F.greatest(p, F.lit(1e-15)))), F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()
    return (float("inf"), 0.0) if row[0] is None else (float(row[0]), float(row[1]))


def successive_halving(fit_part: DataFrame, valid: DataFrame, label: str, reg_params: Sequence[float],
                       make: Callable[[float, int], LogisticRegression], budgets: Sequence[int], patience: int = 1,
                       min_gain: float = 1e-4, parallelism: int = 3) -> tuple[float, int, list[tuple]]:
    """Regularisation and iteration budget by validation loss.

    Budgets grow from step to step.  A step fits every candidate that is left with its
    budget (side by side), and drops the worse half of them.  When the best
    validation loss has not fallen by ``min_gain`` for ``patience`` steps the search stops; the
    best step's setting is returned, whichever step that was (ties: the earlier), with
    the rows of ``HISTORY``: losses and accuracies of both parts for every fit."""
    from concurrent.futures import ThreadPoolExecutor

    def run(setting: tuple[float, int]) -> tuple[float, float, float, float]:
        model = make(*setting).fit(fit_part)
        return (*loss_and_accuracy(model.transform(fit_part), label), *loss_and_accuracy(model.transform(valid), label))

    alive, rows, best, stale = [float(r) for r in reg_params], [], None, 0
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        for step, budget in enumerate(sorted(int(b) for b in budgets)):
            found = list(pool.map(run, [(reg, budget) for reg in alive]))
            order = sorted(range(len(alive)), key=lambda i: (found[i][2], i))
            kept = set(order[:-(-len(order) // 2)])
            rows += [(step, reg, budget, *found[i], i in kept) for i, reg in enumerate(alive)]
            loss = found[order[0]][2]
            if best is None or loss < best[0] - min_gain:
                best, stale = (loss, alive[order[0]], budget), 0
            else:
                stale += 1
                if stale >= patience:
                    break
            alive = [reg for i, reg in enumerate(alive) if i in kept]
    return best[1], best[2], [(*r, (r[1], r[2]) == best[1:]) for r in rows]


def select_sentiment_model(train: DataFrame, key: str, text: str = "text", label: str = "label",
                           reg_params=(0.001, 0.01, 0.1), budgets=(10, 30, 90), patience: int = 1,
                           train_ratio: float = 0.8, seed: int = 42, parallelism: int = 3):
    """The sentiment classifier with the regularisation and the iteration budget that a
    validation part prefers (``successive_halving``: early stopping).

    Texts are tokenised and hashed once.  A key hash splits off the validation
    part, so the split does not depend on the layout; IDF comes from the rest.
    The best setting is fitted on all of ``train``.  Returns the model and the
    training history (``HISTORY``)."""
    stages, counts = term_counts(train, text, [key, label])
    fit_part, valid = hash_split(counts, [train_ratio, 1 - train_ratio], [key], seed + 1)
    idf = text_stages()[-1].fit(fit_part)
    fit_part = fit_part.withColumn("weight", class_weight(fit_part, label))
    fit_part = idf.transform(fit_part).drop("rawFeatures").persist(StorageLevel.MEMORY_AND_DISK)
    valid = idf.transform(valid).drop("rawFeatures").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        reg, budget, rows = successive_halving(fit_part, valid, label, reg_params,
                                               lambda reg, n: sentiment_lr(label, True, n, reg), budgets, patience, parallelism=parallelism)
    finally:
        fit_part.unpersist()
        valid.unpersist()
    model = fit_sentiment_on_counts(stages, counts, label, budget, reg)
    return model, train.sparkSession.createDataFrame(rows, HISTORY)


def load_or_fit(spark: SparkSession, path: str | None, fit: Callable[[], PipelineModel],
                refit: bool = False) -> PipelineModel:
    """Reuse the model saved at ``path`` (a shared folder) or fit and save it;
    without a path only fit."""
    if path is None:
        return fit()
    if not refit and path_exists(spark, path):
        return PipelineModel.load(path)
    model = fit()
    model.write().overwrite().save(path)
    return model


def load_or_fit_with_history(spark: SparkSession, path: str | None,
                             fit: Callable[[], tuple[PipelineModel, DataFrame]]) -> tuple[PipelineModel, DataFrame | None]:
    """As ``load_or_fit``, with the training history kept as a table beside the model
    (``<path>-history``); None where a model was saved without one."""
    if path is None:
        return fit()
    table = f"{path.rstrip('/')}-history"
    if path_exists(spark, path):
        return PipelineModel.load(path), spark.read.parquet(table) if path_exists(spark, table) else None
    model, history = fit()
    # the model last: a folder without it is fitted anew
    history.write.mode("overwrite").parquet(table)
    model.write().overwrite().save(path)
    return model, spark.read.parquet(table)
