"""Physical-plan properties: pushdown, pruning, top-k, partial aggregation,
no Python on the relational paths."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from ratelens.plans.registry import ORACLE

QUERIES = entry.queries()
# queries whose plan legitimately contains Python (vocabulary lookup, models)
PYTHON_OK = {"txt_encode_pad", "snk_encoder_roundtrip"}
RELATIONAL = [n for n in ORACLE if n not in PYTHON_OK]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", RELATIONAL)
def test_no_python_udf(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    assert not any(t in p for t in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInArrow",
                                    "MapInPandas"))


@pytest.mark.parametrize("name", ["q1_top_categories", "q6_top_users"])
def test_topk_is_take_ordered(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().sparkPlan().toString()


def test_filter_pushed_and_columns_pruned(spark):
    p = plan(QUERIES["q4_price_mix"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(p_name), StringContains(p_name,widget)" in p
    assert "ReadSchema: struct<p_name:string,p_type:string>" in p


def test_nested_field_pruned(spark):
    from pyspark.sql import functions as F
    path = SF_SMALL + "/events.parquet"
    df = spark.read.parquet(path).select("event_type", F.struct("event_id", "value").alias("s"))
    p = plan(df.select(F.col("s.value")))
    assert "ReadSchema: struct<value:double>" in p


def test_partial_aggregation_before_shuffle(spark):
    p = plan(QUERIES["q2_geo_distribution"](spark, SF_SMALL))
    assert "partial_avg" in p and "partial_count" in p


def test_share_total_is_scalar_subquery_not_global_window(spark):
    df = QUERIES["q13_category_share"](spark, SF_SMALL)
    p = df._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" in p.lower() or "ScalarSubquery" in p
    assert "Window" not in p


def test_encode_uses_arrow_not_row_udf(spark):
    p = plan(QUERIES["txt_encode_pad"](spark, SF_SMALL))
    assert "MapInArrow" in p and "BatchEvalPython" not in p


def test_community_taste_joins_once(spark):
    """The counts are written once: the result scans them, no lineitem scan is left."""
    p = QUERIES["q12_community_taste"](spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "lineitem" not in p


def test_regression_metrics_scan_once(spark):
    df = QUERIES["q13_regression_metrics"](spark, SF_SMALL)
    p = df._jdf.queryExecution().optimizedPlan().toString()
    assert "subquery" not in p.lower()
