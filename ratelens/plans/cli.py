"""Run one task on the review data set (Q14).

    spark-submit --py-files ratelens.zip run.py 2 --root hdfs:///data/reviews --fmt json --out hdfs:///out
    python -m ratelens.plans.cli 1 --root /data/reviews --fmt parquet --out outputs

where ``run.py`` is ``from ratelens.plans.cli import main; main()``.  The
session is the submitted application's (its master and settings are kept).

Task ids are those of the data set's task list (1-6 statistics, 71, 7, 8, 9,
10, 11 research; 12 = friend-graph communities), ``score`` scores reviews with a
saved sentiment model, ``report`` makes the chart tables.  Each task reads only
the collections it needs and writes every result in full (parquet); results that
are shown also get a preview CSV, the first rows in the result's order.  With
``--models`` fitted models are saved there and reused.  Nothing is collected.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.operators import report
from ratelens.operators.anomaly import anomaly_counts, statistical_anomalies
from ratelens.operators.topk import asc, desc, ordered
from ratelens.plans import ml_tasks, tasks
from ratelens.session import path_exists
from ratelens.sources import read_collection, read_table, save_full, save_preview

COLLECTIONS = ("business", "review", "user")
#: Rows a classifier is fitted on at most; every row is scored.
FIT_ROWS = 500_000
REG_PARAMS = (0.001, 0.01, 0.1)
FILE_FORMATS = ("json", "parquet", "csv", "orc")


@dataclass
class Inputs:
    spark: SparkSession
    root: str
    fmt: str = "json"
    options: dict[str, str] = field(default_factory=dict)
    models: str | None = None

    def __getattr__(self, name: str) -> DataFrame:
        if name not in COLLECTIONS:
            raise AttributeError(name)
        if self.fmt in FILE_FORMATS:
            return read_table(self.spark, self.root, name, fmt=self.fmt, **self.options)
        return read_collection(self.spark, name, self.fmt, **self.options)

    def model(self, name: str) -> str | None:
        return f"{self.models.rstrip('/')}/{name}" if self.models else None


#: name -> (table, rows of its preview or None, columns that order the preview;
#: no columns: the table is ordered)
Outputs = dict[str, tuple[DataFrame, int | None, list]]


def _stat(fn: Callable[[Inputs], DataFrame], name: str, n: int = 20) -> Callable[[Inputs], Outputs]:
    return lambda i: {name: (fn(i), n, [])}


def _task_8(i: Inputs) -> Outputs:
    b = i.business
    return {"research_2_wifi_correlation": (tasks.wifi_rating(b), 20, []),
            "research_2_parking_correlation": (tasks.parking_rating(b), 20, [])}


def _task_9(i: Inputs) -> Outputs:
    r = i.review
    return {"research_3_length_vs_stars": (tasks.length_vs_stars(r), 20, []),
            "research_3_correlation": (tasks.length_correlation(r), 20, [])}


def _task_10(i: Inputs) -> Outputs:
    res = ml_tasks.fans_regression(tasks.fans_features(i.user, keep=("user_id",)))
    return {"research_4_feature_importance": (res.tables["importance"], 20, ["feature"]),
            "research_4_predictions_sample": (res.tables["keyed_predictions"], 20, ["user_id"]),
            "research_4_metrics": (res.tables["metrics"], 20, [])}


def _task_11(i: Inputs) -> Outputs:
    b = i.business
    saved = i.model("sentiment")
    # a saved task-7 model is used; without one the scores are out of fold
    model = PipelineModel.load(saved) if saved and path_exists(i.spark, saved) else None
    sem = ml_tasks.semantic_anomaly_task(i.review.select("review_id", "business_id", "stars", "text"), model=model)
    return {"research_5_statistical_anomalies": (statistical_anomalies(b), 20, ["anomaly_class", "business_id"]),
            "research_5_anomaly_counts": (anomaly_counts(b), 20, []),
            "research_5_semantic_anomalies": (sem.tables["anomalies"], 20, ["review_id"])}


def _task_71(i: Inputs) -> Outputs:
    res = ml_tasks.star_prediction(i.review, fit_rows=FIT_ROWS, model_path=i.model("stars"))
    return {"research_1_sentiment_predictions": (res.tables["predictions"], 20, ["stars", "prediction"]),
            "research_1_accuracy": (res.tables["accuracy"], 20, [])}


def _task_7(i: Inputs) -> Outputs:
    res = ml_tasks.sentiment(i.review, reg_params=REG_PARAMS, model_path=i.model("sentiment"))
    out = {"predictions_with_existing_model": (res.tables["predictions"], None, []),
           "research_7_metrics": (res.tables["metrics"], 20, []),
           "research_7_preview": (res.tables["preview"], 10, ["review_id"])}
    if "history" in res.tables:
        out["research_7_history"] = (res.tables["history"], 100, ["step", "reg_param"])
    if "selection" in res.tables:
        out["research_7_selection"] = (res.tables["selection"], 20, ["reg_param", "max_iter"])
    return out


def _task_score(i: Inputs) -> Outputs:
    """New reviews scored with the model that task 7 saved."""
    saved = i.model("sentiment")
    if not saved or not path_exists(i.spark, saved):
        raise FileNotFoundError("no saved sentiment model: run task 7 with --models first")
    reviews = i.review.select("review_id", "text", F.col("stars").alias("true_stars")).filter("text is not null")
    return {"scored_reviews": (ml_tasks.score_new(PipelineModel.load(saved), reviews), 20, ["review_id"])}


def _task_12(i: Inputs) -> Outputs:
    from ratelens.operators import graph
    users = i.user.select("user_id", "friends")
    comps = graph.connected_components(users.select("user_id"), graph.friend_edges(users))
    review = i.review.select("user_id", "business_id")
    biz = i.business.select("business_id", "categories")
    return {"research_6_community_categories": (community_categories(comps, review, biz), None, [])}


def community_categories(comps: DataFrame, review: DataFrame, business: DataFrame, k: int = 5) -> DataFrame:
    """Top-k categories reviewed per community with share and lift (review
    data set form of the community-taste table).  Business categories are
    exploded once per business, then joined to per-(community, business) counts:
    a business with very many reviews is combined before that join."""
    from ratelens.operators.graph import taste_table
    per_ub = review.groupBy("user_id", "business_id").agg(F.count(F.lit(1)).alias("n"))
    cats = business.select("business_id", F.explode(F.split("categories", ", ")).alias("category"))
    cc = (per_ub.join(comps.select("user_id", F.col("component").alias("community")), "user_id")
          .groupBy("community", "business_id").agg(F.sum("n").alias("n"))
          .join(cats, "business_id")
          .groupBy("community", "category").agg(F.sum("n").cast("bigint").alias("n")))
    return taste_table(cc, k)


def _task_report(i: Inputs) -> Outputs:
    """The chart tables, from the collections themselves."""
    b = i.business
    geo = tasks.geo_distribution(b)
    anomalies = statistical_anomalies(b)
    return {"report_category_share": (report.category_share(tasks.top_categories(b)), 15, [desc("count"), asc("category")]),
            "report_state_share": (report.state_share(geo), 8, [desc("business_count"), asc("state")]),
            "report_top_cities": (report.top_cities(geo), 15, []),
            "report_open_closed": (report.open_closed(tasks.open_share_by_city(b)), 12, [desc("total_count"), asc("city")]),
            "report_price_share": (report.price_share(tasks.price_mix(b)), 20, [asc("price_range")]),
            "report_monthly_series": (report.monthly_series(tasks.monthly_activity(i.review)), 20, ["year_month"]),
            "report_top_user_quantiles": (report.top_user_quantiles(tasks.top_users(i.user)), 20, []),
            "report_anomaly_types": (report.anomaly_type_counts(anomalies), 20, [])}


TASKS: dict[str, Callable[[Inputs], Outputs]] = {
    "1": _stat(lambda i: tasks.top_categories(i.business), "stat_1_top_categories"),
    "2": _stat(lambda i: tasks.geo_distribution(i.business), "stat_2_geo_dist"),
    "3": _stat(lambda i: tasks.open_share_by_city(i.business), "stat_3_open_closed"),
    "4": _stat(lambda i: tasks.price_mix(i.business), "stat_4_price_dist"),
    "5": _stat(lambda i: tasks.monthly_activity(i.review), "stat_5_user_activity"),
    "6": _stat(lambda i: tasks.top_users(i.user), "stat_6_top_users", 100),
    "71": _task_71,
    "7": _task_7,
    "8": _task_8,
    "9": _task_9,
    "10": _task_10,
    "11": _task_11,
    "12": _task_12,
    "score": _task_score,
    "report": _task_report,
}


def run_task(spark: SparkSession, name: str, root: str, fmt: str = "json", options: dict[str, str] | None = None,
             models: str | None = None) -> Outputs:
    if name not in TASKS:
        raise KeyError(f"unknown task {name!r}; choose one of {sorted(TASKS)}")
    return TASKS[name](Inputs(spark, root, fmt, options or {}, models))


def write_outputs(outputs: Outputs, out_dir: str) -> None:
    """Every table in full; the preview is taken from the written table's rows in
    the given order (an ordered result is previewed as it is)."""
    for name, (df, n, order) in outputs.items():
        save_full(df, f"{out_dir}/{name}")
        if n is not None:
            save_preview(ordered(df.sparkSession.read.parquet(f"{out_dir}/{name}"), order) if order else df,
                         f"{out_dir}/{name}.csv", n=n)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.split("\n\n")[0])
    ap.add_argument("task", choices=sorted(TASKS))
    ap.add_argument("--root", default="", help="folder holding business / review / user (file formats)")
    ap.add_argument("--fmt", default="json", help="json, parquet, csv, orc or a connector's format name")
    ap.add_argument("--option", action="append", default=[], metavar="KEY=VALUE", help="reader option; repeatable")
    ap.add_argument("--models", help="folder of saved models: used if there, else written")
    ap.add_argument("--out", default="outputs")
    args = ap.parse_args(argv)
    from ratelens.session import apply_scale_settings, clean_run, cluster_session, input_bytes
    submitted = SparkSession.getActiveSession() is None
    spark = cluster_session()
    if submitted and args.fmt in FILE_FORMATS:
        apply_scale_settings(spark, input_bytes(spark, args.root))
    write_outputs(run_task(spark, args.task, args.root, args.fmt, dict(o.split("=", 1) for o in args.option),
                           args.models), args.out)
    if submitted:  # a caller's session may still need its intermediate tables
        clean_run(spark)


if __name__ == "__main__":
    main()
