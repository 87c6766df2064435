"""Restartable bulk scoring with Structured Streaming.

The reference scores a large collection in 500 000-row pages and intends to
checkpoint every few pages.  Here the pass is a file-source stream with
``trigger(availableNow=True)``: every file present at start is scored once, in
``maxFilesPerTrigger``-sized micro-batches.

Each micro-batch is committed twice over: its rows overwrite the folder of its own
batch id in the sink (``foreachBatch``), then the stream's checkpoint records the
batch.  A run that dies in between repeats that batch from the same files into the same
folder, so a restart neither loses nor doubles a row.

A pass belongs to one model: ``pass_dir`` names its folder by the tables' files and a
fingerprint of what the model has learned, so another model scores everything anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ratelens.ml.models import sentiment_scores
from ratelens.session import is_file, lasting_dir

#: Sink folders are ``<this>=<batch id>``.
BATCH = "scoring_batch"


def model_fingerprint(model: PipelineModel) -> str:
    """Hash of a pipeline's stages, settings and learned values; a saved and reloaded model has the
    same one."""
    digest = hashlib.sha256()
    for stage in model.stages:
        digest.update(type(stage).__name__.encode())
        for param, value in sorted(stage.extractParamMap().items(), key=lambda kv: kv[0].name):
            # columns named after the stage itself carry a random id
            if stage.uid not in str(value):
                digest.update(f"{param.name}={value};".encode())
        for learned in ("idf", "coefficientMatrix", "interceptVector"):
            if hasattr(stage, learned):
                digest.update(getattr(stage, learned).toArray().tobytes())
        if hasattr(stage, "toDebugString"):
            digest.update(str(stage.toDebugString).split("\n", 1)[1].encode())
    return digest.hexdigest()[:16]


def pass_dir(spark: SparkSession, stamp: object, model: PipelineModel) -> str:
    """The lasting folder of one pass: of these files (``table_stamp``) by this model."""
    files = hashlib.sha256(repr(stamp).encode()).hexdigest()[:16]
    return lasting_dir(spark, f"stream/{files}-{model_fingerprint(model)}")


def scoring_stream(spark: SparkSession, source: str, schema: T.StructType, fmt: str = "parquet",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """File-source stream over the table at ``source``: a folder of part files, or
    one file (a file source watches folders, so its folder filtered to its name)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if is_file(spark, source):
        source, _, name = source.rpartition("/")
        reader = reader.option("pathGlobFilter", name)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(source)


def start_scoring(model: PipelineModel, stream: DataFrame, sink: str, checkpoint: str,
                  threshold: float = 0.5, fmt: str = "parquet", label_col: str | None = "true_sentiment",
                  after_batch: Callable[[int], None] | None = None) -> StreamingQuery:
    """Score every row of ``stream`` (a stateless map) into ``sink``, a folder per micro-batch.
    ``after_batch`` is called with the batch id once its rows are written."""
    scored = sentiment_scores(model, stream, threshold)
    if label_col and label_col in stream.columns:
        scored = scored.withColumn("correct", F.col("predicted_sentiment") == F.col(label_col))

    def commit(batch: DataFrame, batch_id: int) -> None:
        batch.write.format(fmt).mode("overwrite").save(f"{sink}/{BATCH}={batch_id}")
        if after_batch:
            after_batch(batch_id)

    return (scored.writeStream.foreachBatch(commit)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start())


def run_scoring(model: PipelineModel, stream: DataFrame, sink: str, checkpoint: str, **kw) -> None:
    """Run the pass to completion (blocks until every available file is done)."""
    q = start_scoring(model, stream, sink, checkpoint, **kw)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def read_scores(spark: SparkSession, sink: str, fmt: str = "parquet") -> DataFrame:
    """All scored rows of a sink."""
    return spark.read.format(fmt).load(sink).drop(BATCH)
