"""Model tasks (Q71, Q7, Q10, Q11c) as plans around Spark ML fits.

Each task returns its result tables as DataFrames; a fit is the only eager step.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.functions.columns import binary_label, preview_text
from ratelens.ml import models
from ratelens.operators.aggregate import regression_metrics
from ratelens.operators.anomaly import semantic_anomalies
from ratelens.operators.sampling import fold_of, hash_sample_n, hash_split, in_first_part, stratified_split
from ratelens.session import RoundStore

# Split fractions and seed of the review tasks.
TRAIN_FRACTION = 0.8
SEED = 42


@dataclass
class ModelResult:
    model: PipelineModel | list
    tables: dict[str, DataFrame] = field(default_factory=dict)


def star_prediction(reviews: DataFrame, key: str = "review_id", text: str = "text", stars: str = "stars",
                    fit_rows: int | None = None, model_path: str | None = None) -> ModelResult:
    """Q71: predict the star class from text; held-out ``stars, prediction``.

    ``fit_rows`` bounds the rows the classifier is fitted on, never the rows that
    are scored.  With ``model_path`` a model saved there is used, or the fitted
    one is saved there."""
    df = reviews.select(key, text, F.col(stars).cast("double").alias("stars")).filter(F.col(text).isNotNull())
    stages, counts = models.term_counts(df, text, [key, "stars"])
    train, test = hash_split(counts, [TRAIN_FRACTION, 1 - TRAIN_FRACTION], [key], SEED)
    if fit_rows is not None:
        train = hash_sample_n(train, fit_rows, [key], SEED)
    model = models.load_or_fit(df.sparkSession, model_path, lambda: models.fit_on_counts(stages, train, models.star_lr()))
    pred = models.transform_counts(model, test).select(key, "stars", "prediction")
    pred = RoundStore(df.sparkSession, "star-predictions").put(pred, "t")
    acc = pred.agg(F.round(F.avg((F.col("stars") == F.col("prediction")).cast("double")), 4).alias("accuracy"),
                   F.count(F.lit(1)).alias("n"))
    return ModelResult(model, {"predictions": pred.select("stars", "prediction"), "accuracy": acc})


def sentiment(reviews: DataFrame, key: str = "review_id", text: str = "text", stars: str = "stars",
              neutral: int = 3, threshold: float = 0.5, reg_params=(0.01,), model_path: str | None = None) -> ModelResult:
    """Q7: binary sentiment (stars > 3) from text; the model scores every row
    with a text (bulk pass) and is evaluated on held-out rows.

    Rows without stars, and neutral ones, train and test nothing but are scored;
    their truth columns are null.  More than one of ``reg_params``: the choice is
    made on a validation split with early stopping; the table ``history`` tells its
    losses and accuracies (``selection``, too, where the search was made now).  ``model_path`` as in ``star_prediction``."""
    from ratelens.plans.tasks import sentiment_input
    rated = sentiment_input(reviews, text, stars, neutral).select(key, text, F.col("true_sentiment").alias("label"))
    train, _ = stratified_split(rated, "label", [key], TRAIN_FRACTION, SEED)
    tables: dict[str, DataFrame] = {}

    spark = reviews.sparkSession
    if len(reg_params) == 1:
        model = models.load_or_fit(spark, model_path, lambda: models.fit_sentiment_classifier(train, text, "label", reg=reg_params[0]))
    else:
        def search() -> tuple[PipelineModel, DataFrame]:
            model, tables["selection"] = models.select_sentiment_model(train, key, text, "label", reg_params)
            return model, tables["selection"]

        model, history = models.load_or_fit_with_history(spark, model_path, search)
        if history is not None:
            tables["history"] = history
    truth = F.when(F.col(stars) != F.lit(neutral), binary_label(stars))
    base = (reviews.filter(F.col(text).isNotNull())
            .select(key, text, F.col(stars).alias("true_stars"), truth.alias("true_sentiment")))
    pred = score_new(model, base, threshold, batched=True).withColumn(
        # held-out rows are recognised by the same key hash that split them: no join
        "held_out", F.col("true_sentiment").isNotNull() & ~in_first_part("true_sentiment", [key], TRAIN_FRACTION, SEED))
    pred = RoundStore(reviews.sparkSession, "sentiment-predictions").put(pred, "t")
    shown = pred.filter("true_sentiment is not null")
    preview = shown.select(key, preview_text(text).alias("text_preview"), "true_stars", "true_sentiment",
                           "predicted_sentiment", "correct")
    return ModelResult(model, {"predictions": pred, "metrics": sentiment_metrics(pred), "preview": preview, **tables})


def score_new(model: PipelineModel, reviews: DataFrame, threshold: float = 0.5, batched: bool = False) -> DataFrame:
    """A saved or fitted sentiment model on any rows with texts: all columns of
    ``reviews``, prediction and score, and ``correct`` where the truth is known."""
    scored = models.sentiment_scores(model, reviews, threshold, batched=batched)
    truth = F.col("true_sentiment") if "true_sentiment" in reviews.columns else F.lit(None).cast("int")
    return scored.select(*reviews.columns, "predicted_sentiment",
                         (F.col("predicted_sentiment") == truth).alias("correct"), "sentiment_score")


def sentiment_metrics(pred: DataFrame) -> DataFrame:
    """Held-out accuracy and log-loss of a scored predictions table."""
    held = pred.filter("held_out")
    p_true = F.when(F.col("true_sentiment") == 1, F.col("sentiment_score")).otherwise(1 - F.col("sentiment_score"))
    return held.agg(
        F.round(F.avg(F.col("correct").cast("double")), 4).alias("accuracy"),
        F.round(F.avg(-F.log(F.greatest(p_true, F.lit(1e-15)))), 4).alias("log_loss"),
        F.count(F.lit(1)).alias("n"))


def out_of_fold_scores(reviews: DataFrame, key: str = "review_id", text: str = "text", stars: str = "stars",
                       folds: int = 3, keep_stars=(1, 5)) -> ModelResult:
    """Sentiment scores where no row is scored by a model that saw it.  Texts are
    tokenised and hashed once; all folds fit on and score that table."""
    from concurrent.futures import ThreadPoolExecutor

    business = F.col("business_id") if "business_id" in reviews.columns else F.lit(None).cast("string").alias("business_id")
    base = (reviews.filter(F.col(text).isNotNull() & F.col(stars).isin(*keep_stars))
            .select(key, text, stars, business, binary_label(stars).alias("label"), fold_of([key], folds, SEED).alias("fold")))
    keep = [key, text, stars, "business_id", "label", "fold"]
    stages, counts = models.term_counts(base, text, keep)
    # the k fits are independent Spark jobs: submitted concurrently, they share
    # the cluster instead of queueing one after another
    with ThreadPoolExecutor(max_workers=min(folds, 4)) as pool:
        fitted = list(pool.map(
            lambda f: models.fit_sentiment_on_counts(stages, counts.filter(F.col("fold") != f).select("label", "rawFeatures")),
            range(folds)))
    parts = [models.sentiment_scores(m, counts.filter(F.col("fold") == f), counted=True) for f, m in enumerate(fitted)]
    scored = reduce(DataFrame.unionByName, parts)
    return ModelResult(fitted, {"scores": scored.select(key, text, stars, "business_id", "sentiment_score")})


def semantic_anomaly_task(reviews: DataFrame, key: str = "review_id", text: str = "text", stars: str = "stars",
                          folds: int = 3, model: PipelineModel | None = None) -> ModelResult:
    """Q11c: five-star reviews with negative text and one-star reviews with
    positive text; scored out of fold, or by a given (saved) sentiment model."""
    if model is None:
        res = out_of_fold_scores(reviews, key, text, stars, folds)
    else:
        business = F.col("business_id") if "business_id" in reviews.columns else F.lit(None).cast("string").alias("business_id")
        extremes = reviews.filter(F.col(text).isNotNull() & F.col(stars).isin(1, 5)).select(key, text, stars, business)
        res = ModelResult(model, {"scores": models.sentiment_scores(model, extremes)})
    anomalies = semantic_anomalies(res.tables["scores"], stars=stars)
    res.tables["anomalies"] = RoundStore(reviews.sparkSession, "semantic-anomalies").put(
        anomalies.select(key, text, stars, "business_id", "sentiment_score", "anomaly_type"), "t")
    return res


FANS_FEATURES = ["review_count", "average_stars", "friend_count"]


def fans_regression(features: DataFrame, key: str = "user_id", feature_cols=FANS_FEATURES, **forest) -> ModelResult:
    """Q10: random forest on (review_count, average_stars, friend_count) ->
    fans; held-out predictions, RMSE / R² and feature importances.  Features and
    predictions are written once; metrics, bound and sample scan them."""
    store = RoundStore(features.sparkSession, "fans")
    df = store.put(features, "features")
    train, test = hash_split(df, [TRAIN_FRACTION, 1 - TRAIN_FRACTION], [key], SEED)
    model = models.fit_fans_forest(train, feature_cols, "label", **forest)
    pred = store.put(model.transform(test).select(key, "label", "prediction"), "predictions")
    imp = models.feature_importances(features.sparkSession, model, feature_cols)
    return ModelResult(model, {"predictions": pred.select("label", "prediction"),
                               "metrics": regression_metrics(pred), "importance": imp, "keyed_predictions": pred})
