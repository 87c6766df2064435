"""Task runner on a small review data set written as JSON lines."""

from __future__ import annotations

import glob
import json
import os
import random

import pytest

from ratelens.plans.cli import main, run_task


def _write(path, docs):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/part-0.json", "w") as f:
        for d in docs:
            f.write(json.dumps(d) + "\n")


@pytest.fixture(scope="module")
def dataset(tmp_path_factory):
    rnd = random.Random(3)
    root = str(tmp_path_factory.mktemp("reviews"))
    cats = ["Restaurants, Bars", "Bars", "Shopping", "Restaurants, Cafes"]
    business = [{"business_id": f"b{i}", "name": f"B{i}", "city": rnd.choice(["Edmonton", "Tampa"]),
                 "state": rnd.choice(["AB", "FL"]), "stars": rnd.choice([1.0, 2.5, 4.0, 5.0]),
                 "review_count": rnd.choice([2, 40, 700]), "is_open": rnd.choice([0, 1]),
                 "categories": cats[i % 4],
                 "attributes": {"WiFi": rnd.choice(["u'free'", "'no'", "None"]),
                                "BusinessParking": rnd.choice(["{'lot': True}", "{'lot': False}"]),
                                "RestaurantsPriceRange2": rnd.choice(["1", "2", "None"])}}
                for i in range(30)]
    good, bad = "great lovely tasty friendly", "awful rude cold dirty"
    review = [{"review_id": f"r{i}", "business_id": f"b{i % 30}", "user_id": f"u{i % 12}",
               "stars": (s := rnd.choice([1, 2, 4, 5])), "date": f"2019-{1 + i % 12:02d}-03 10:00:00",
               "text": (good if s > 3 else bad) + f" visit {i}"} for i in range(120)]
    user = [{"user_id": f"u{i}", "name": f"U{i}", "review_count": 5 + i, "average_stars": 3.5,
             "fans": i % 4, "friends": ", ".join(f"u{j}" for j in (i - 1, i + 1) if 0 <= j < 12 and j // 6 == i // 6)
             or "None"} for i in range(12)]
    _write(f"{root}/business.json", business)
    _write(f"{root}/review.json", review)
    _write(f"{root}/user.json", user)
    return root


def test_statistics_tasks(spark, dataset):
    for task, name in [("1", "stat_1_top_categories"), ("2", "stat_2_geo_dist"), ("3", "stat_3_open_closed"),
                       ("4", "stat_4_price_dist"), ("5", "stat_5_user_activity"), ("6", "stat_6_top_users")]:
        out = run_task(spark, task, dataset)
        df, n, _ = out[name]
        assert df.count() > 0 and n in (20, 100)
    top = run_task(spark, "6", dataset)["stat_6_top_users"][0].collect()
    assert top[0].user_id == "u11" and top[0].review_count == 16


def test_research_tasks_and_outputs(spark, dataset, tmp_dir):
    out = run_task(spark, "8", dataset)
    assert set(out) == {"research_2_wifi_correlation", "research_2_parking_correlation"}
    comm = run_task(spark, "12", dataset)["research_6_community_categories"][0].collect()
    assert {r.community for r in comm} == {"u0", "u10"}   # string order
    main(["9", "--root", dataset, "--out", tmp_dir])
    files = glob.glob(f"{tmp_dir}/research_3_length_vs_stars.csv/*.csv")
    assert len(files) == 1
    with open(files[0]) as f:
        assert f.readline().strip() == "stars,avg_length,review_count"


def test_model_task(spark, dataset):
    out = run_task(spark, "7", dataset)
    m = out["research_7_metrics"][0].collect()[0]
    assert m.n > 0 and m.accuracy >= 0.5


def test_full_tables_previews_and_saved_models(spark, dataset, tmp_dir):
    args = ["--root", dataset, "--out", f"{tmp_dir}/out", "--models", f"{tmp_dir}/models"]
    main(["5", *args])
    want = run_task(spark, "5", dataset)["stat_5_user_activity"][0].count()
    assert spark.read.parquet(f"{tmp_dir}/out/stat_5_user_activity").count() == want
    main(["71", *args])
    first = spark.read.parquet(f"{tmp_dir}/out/research_1_sentiment_predictions").count()
    held_out = run_task(spark, "71", dataset)["research_1_sentiment_predictions"][0].count()
    assert first == held_out > 0
    main(["7", *args])
    scored = spark.read.parquet(f"{tmp_dir}/out/predictions_with_existing_model")
    assert scored.count() == 120 and os.path.exists(f"{tmp_dir}/out/research_7_selection")
    # the second run reuses the saved model: nothing is selected again
    assert "research_7_selection" not in run_task(spark, "7", dataset, models=f"{tmp_dir}/models")
    main(["score", *args])
    again = spark.read.parquet(f"{tmp_dir}/out/scored_reviews")
    both = scored.select("review_id", "sentiment_score").join(
        again.select("review_id", again.sentiment_score.alias("s")), "review_id").collect()
    assert len(both) == 120 and all(abs(r.sentiment_score - r.s) < 1e-12 for r in both)
    assert run_task(spark, "11", dataset, models=f"{tmp_dir}/models")["research_5_semantic_anomalies"][0].count() >= 0
    with pytest.raises(FileNotFoundError):
        run_task(spark, "score", dataset, models=f"{tmp_dir}/none")


def test_report_task(spark, dataset, tmp_dir):
    main(["report", "--root", dataset, "--out", tmp_dir])
    cities = [r.city for r in spark.read.parquet(f"{tmp_dir}/report_top_cities").collect()]
    assert sorted(cities) == ["Edmonton", "Tampa"]
    assert len(glob.glob(f"{tmp_dir}/report_*.csv")) == 8


def test_connector_gets_the_collection_name(spark, dataset):
    from ratelens.plans.cli import Inputs
    seen = []

    class Reader:
        def __getattr__(self, name):
            def call(*args, **kw):
                seen.append((name, args, kw))
                return self
            return call

    class Session:
        read = Reader()

    Inputs(Session(), "", "some.connector", {"uri": "x"}).review
    assert ("options", (), {"collection": "review", "uri": "x"}) in seen


def test_submitted_master_is_kept(tmp_path, dataset):
    """A submitted run keeps its master; the CLI adds none of its own."""
    import subprocess
    import sys
    from pathlib import Path
    code = ("from pyspark.sql import SparkSession\n"
            "from ratelens.plans.cli import main\n"
            f"main(['2', '--root', {dataset!r}, '--out', {str(tmp_path / 'out')!r}])\n"
            "print('MASTER', SparkSession.getActiveSession().sparkContext.master)\n")
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false "
                        f"--conf spark.checkpoint.dir={tmp_path}/ckpt pyspark-shell"}
    root = Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env=env, capture_output=True, text=True, timeout=200)
    assert "MASTER local[2]" in done.stdout, done.stderr[-1500:]
    left = [p for p in (tmp_path / "ckpt").rglob("*") if p.is_file()] if (tmp_path / "ckpt").exists() else []
    assert left == []
