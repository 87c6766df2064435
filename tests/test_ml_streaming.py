"""Models (rows-only + quality floors), save/load, restartable stream scoring."""

from __future__ import annotations

import os
import shutil

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_MID, SF_SMALL
from ratelens.ml import models
from ratelens.plans import ml_tasks, oracle_sql
from ratelens.plans import standins as S
from ratelens.streaming.scoring import model_fingerprint, pass_dir, read_scores, run_scoring, scoring_stream

Q = entry.queries()


def test_star_prediction_quality(spark):
    acc = Q["q71_accuracy"](spark, SF_MID).collect()[0]
    assert acc.n > 100 and acc.accuracy > 0.8
    preds = Q["q71_star_predictions"](spark, SF_MID)
    assert preds.columns == ["stars", "prediction"] and preds.count() == acc.n


def test_sentiment_rows_and_metrics(spark):
    preds = Q["q7_sentiment_predictions"](spark, SF_SMALL)
    # every document is scored; only labelled ones train and count as right or wrong
    assert preds.count() == spark.read.parquet(SF_SMALL + "/documents.parquet").filter("text is not null").count()
    labels = spark.read.parquet(SF_SMALL + "/labels.parquet").count()
    assert preds.filter("true_sentiment is not null").count() == labels
    m = Q["q7_sentiment_metrics"](spark, SF_SMALL).collect()[0]
    assert 0 <= m.accuracy <= 1 and m.n == preds.filter("held_out").count()
    totals = Q["q7_sentiment_totals"](spark, SF_SMALL).collect()[0]
    assert totals.total_count == labels
    assert totals.positive_count + totals.negative_count == labels


def test_semantic_anomalies_are_out_of_fold(spark):
    res = ml_tasks.semantic_anomaly_task(S.reviews(spark, SF_SMALL), folds=3)
    scores = res.tables["scores"]
    assert scores.count() == S.reviews(spark, SF_SMALL).count()
    an = res.tables["anomalies"].collect()
    for r in an:
        assert (r.stars == 5 and r.sentiment_score < 0.2) or (r.stars == 1 and r.sentiment_score > 0.8)


def test_fans_regression(spark):
    imp = {r.feature: r.importance for r in Q["q10_feature_importance"](spark, SF_SMALL).collect()}
    assert set(imp) == {"review_count", "average_stars", "friend_count"}
    assert abs(sum(imp.values()) - 1.0) < 1e-6
    m = Q["q10_fans_metrics"](spark, SF_SMALL).collect()[0]
    assert m.n > 0 and m.rmse >= 0


def test_load_or_fit_roundtrip(spark, tmp_dir):
    reviews = S.reviews(spark, SF_SMALL).select("review_id", "text", "stars")
    train = reviews.withColumn("label", (F.col("stars") > 3).cast("int"))
    calls = []

    def fit():
        calls.append(1)
        return models.fit_sentiment_classifier(train, "text", "label", max_iter=10)

    path = f"{tmp_dir}/model"
    m1 = models.load_or_fit(spark, path, fit)
    m2 = models.load_or_fit(spark, path, fit)
    assert len(calls) == 1
    a = models.sentiment_scores(m1, train).select("review_id", "sentiment_score").orderBy("review_id").collect()
    b = models.sentiment_scores(m2, train).select("review_id", "sentiment_score").orderBy("review_id").collect()
    assert a == b


def labelled(spark):
    return S.reviews(spark, SF_SMALL).select("review_id", "text", (F.col("stars") > 3).cast("int").alias("true_sentiment"))


def small_model(reviews, **settings):
    return models.fit_sentiment_classifier(reviews.withColumnRenamed("true_sentiment", "label"), "text", "label", **settings)


def rows_of(df, *columns):
    return sorted(map(repr, map(tuple, df.select(*columns).collect())))


def test_stream_scoring_restartable(spark, tmp_dir):
    reviews = labelled(spark)
    model = small_model(reviews, max_iter=10)
    src = f"{tmp_dir}/in"
    reviews.repartition(3).write.parquet(src)
    out, ckpt = f"{tmp_dir}/out", f"{tmp_dir}/ckpt"
    stream = scoring_stream(spark, src, reviews.schema, max_files_per_trigger=1)
    run_scoring(model, stream, out, ckpt)
    n = reviews.count()
    want = models.sentiment_scores(model, reviews)
    assert rows_of(read_scores(spark, out), "review_id", "predicted_sentiment") == rows_of(want, "review_id", "predicted_sentiment")
    # a restart with the same checkpoint finds nothing new: exactly-once output
    run_scoring(model, scoring_stream(spark, src, reviews.schema), out, ckpt)
    assert read_scores(spark, out).count() == n
    # new input files are picked up by the next run
    reviews.limit(5).write.mode("append").parquet(src)
    run_scoring(model, scoring_stream(spark, src, reviews.schema), out, ckpt)
    assert read_scores(spark, out).count() == n + 5


def test_a_run_that_dies_between_batches_goes_on(spark, tmp_dir):
    """The batch whose rows were written but not recorded is repeated into its own folder."""
    reviews = labelled(spark)
    model = small_model(reviews, max_iter=5)
    src, out, ckpt = (f"{tmp_dir}/{x}" for x in ("in", "out", "ckpt"))
    reviews.repartition(4).write.parquet(src)
    seen = []

    def die(batch_id):
        seen.append(batch_id)
        if batch_id == 1:
            raise RuntimeError("executor and driver are gone")

    with pytest.raises(Exception):
        run_scoring(model, scoring_stream(spark, src, reviews.schema, max_files_per_trigger=1), out, ckpt, after_batch=die)
    partial = read_scores(spark, out).count()
    assert seen == [0, 1] and 0 < partial < reviews.count()
    run_scoring(model, scoring_stream(spark, src, reviews.schema, max_files_per_trigger=1), out, ckpt, after_batch=seen.append)
    assert seen == [0, 1, 1, 2, 3]
    assert rows_of(read_scores(spark, out), "review_id") == rows_of(reviews, "review_id")


def test_another_model_scores_anew(spark, tmp_dir):
    reviews = labelled(spark)
    one, two = small_model(reviews, max_iter=5), small_model(reviews, max_iter=5, reg=0.5)
    one.write().overwrite().save(f"{tmp_dir}/m")
    again = PipelineModel.load(f"{tmp_dir}/m")
    assert model_fingerprint(one) == model_fingerprint(again) == model_fingerprint(small_model(reviews, max_iter=5))
    assert model_fingerprint(one) != model_fingerprint(two)
    src, stamp = f"{tmp_dir}/in", tmp_dir
    reviews.write.parquet(src)
    got = []
    for model in (one, two):
        run_dir = pass_dir(spark, stamp, model)
        run_scoring(model, scoring_stream(spark, src, reviews.schema), f"{run_dir}/out", f"{run_dir}/checkpoint")
        got.append(read_scores(spark, f"{run_dir}/out"))
    scores = [{r.review_id: r.sentiment_score for r in g.collect()} for g in got]
    assert scores[0].keys() == scores[1].keys() and scores[0] != scores[1]


def test_stream_query_columns(spark, duck):
    got = Q["q7_stream_scores"](spark, SF_SMALL)
    assert got.columns == ["review_id", "true_stars", "true_sentiment", "n_chars", "predicted_sentiment", "correct", "sentiment_score"]
    want = sorted(map(repr, duck.execute(oracle_sql.STREAM_ROWS).fetchall()))
    assert rows_of(got, "review_id", "true_stars", "true_sentiment", "n_chars") == want
    for r in got.collect():
        assert r.predicted_sentiment == int(r.sentiment_score > 0.5) or abs(r.sentiment_score - 0.5) < 1e-3
        assert r.correct == (None if r.true_sentiment is None else r.predicted_sentiment == r.true_sentiment)


def test_stream_over_a_folder_table_scores_the_same_rows(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/sf")
    for name in os.listdir(SF_SMALL):
        if name != "documents.parquet":  # the copies must not take over that the tables are read-only
            shutil.copyfile(f"{SF_SMALL}/{name}", f"{tmp_dir}/sf/{name}")
    spark.read.parquet(f"{SF_SMALL}/documents.parquet").repartition(4).write.parquet(f"{tmp_dir}/sf/documents.parquet")
    one = {r.review_id for r in Q["q7_stream_scores"](spark, SF_SMALL).collect()}
    parts = {r.review_id for r in Q["q7_stream_scores"](spark, f"{tmp_dir}/sf").collect()}
    assert one == parts and len(one) == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()


def test_results_follow_changed_tables(spark, tmp_dir):
    from ratelens.plans.registry import txt_vocabulary
    docs = spark.createDataFrame([(1, "old words")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_dir}/documents.parquet")
    assert {r.word for r in txt_vocabulary(spark, tmp_dir).collect()} == {"old", "words"}
    docs.selectExpr("doc_id", "'new ones' as text").write.mode("overwrite").parquet(f"{tmp_dir}/documents.parquet")
    assert {r.word for r in txt_vocabulary(spark, tmp_dir).collect()} == {"new", "ones"}


def test_selection_does_not_depend_on_the_layout(spark):
    reviews = S.reviews(spark, SF_SMALL).select("review_id", "text", (F.col("stars") > 3).cast("int").alias("label"))
    a, b = (models.select_sentiment_model(r, "review_id", reg_params=(0.01, 0.1), budgets=(10,))[1].collect()
            for r in (reviews, reviews.repartition(3)))
    assert [(r.reg_param, round(r.val_loss, 6), round(r.val_accuracy, 6)) for r in a] == [
        (r.reg_param, round(r.val_loss, 6), round(r.val_accuracy, 6)) for r in b]


def noisy(spark, n, seed):
    """Labels that follow one feature weakly, among many that mean nothing."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 40))
    y = (x[:, 0] + rng.normal(size=n) * 1.5 > 0).astype(float)
    return spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"])


def test_early_stopping_keeps_a_smaller_budget(spark):
    train, valid = noisy(spark, 60, 1), noisy(spark, 400, 2)
    reg, budget, rows = models.successive_halving(
        train, valid, "label", (0.0,), lambda r, n: models.star_lr("label", n, r), (1, 2, 4, 8, 16, 32, 64, 128), patience=2)
    tried = [r[2] for r in rows]
    assert budget < tried[-1] < 128  # stopped two steps after the best
    assert tried == [1, 2, 4, 8, 16, 32, 64, 128][:len(tried)] and tried.index(budget) == len(tried) - 3
    losses = [r[5] for r in rows]
    assert losses[tried.index(budget)] == min(losses) and rows[-1][3] < rows[0][3]  # training loss falls all the time
    assert [r[-1] for r in rows] == [b == budget for b in tried]


def test_halving_drops_the_worse_half(spark):
    train, valid = noisy(spark, 200, 3), noisy(spark, 400, 4)
    regs = (0.0, 0.01, 0.05, 5.0)
    reg, budget, rows = models.successive_halving(
        train, valid, "label", regs, lambda r, n: models.star_lr("label", n, r), (2, 4, 8), patience=3)
    by_step = {s: [r for r in rows if r[0] == s] for s in (0, 1, 2)}
    assert [len(by_step[s]) for s in (0, 1, 2)] == [4, 2, 1]
    for s in (0, 1):
        kept = {r[1] for r in by_step[s] if r[7]}
        assert kept == {r[1] for r in by_step[s + 1]}
        assert max(r[5] for r in by_step[s] if r[7]) <= min(r[5] for r in by_step[s] if not r[7])
    assert reg in regs and sum(r[-1] for r in rows) == 1


def test_history_is_kept_beside_the_model(spark, tmp_dir):
    reviews = S.reviews(spark, SF_SMALL).select("review_id", "text", "stars")
    path = f"{tmp_dir}/model"
    first = ml_tasks.sentiment(reviews, reg_params=(0.01, 0.1), model_path=path).tables["history"].collect()
    again = ml_tasks.sentiment(reviews, reg_params=(0.01, 0.1), model_path=path).tables["history"]
    assert sorted(map(repr, again.collect())) == sorted(map(repr, first)) and len(first) >= 2
    assert sum(r.best for r in first) == 1
    assert all(r.train_loss > 0 and 0 <= r.val_accuracy <= 1 for r in first)
