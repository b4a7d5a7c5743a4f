"""What the plans must look like."""

import pytest

from tableflow.plans.queries import QUERIES


# These write files or walk a graph while the query is built, which other tests cover.
LAZY = [n for n in QUERIES if not n.startswith(("io_", "snap_", "lineage_", "stream_", "fp_prop", "refresh_"))]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_cross_join(spark, small, name):
    plan = plan_of(QUERIES[name](spark, small))
    for word in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = QUERIES["z10_borough_day"](spark, small)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "GreaterThan(l_extendedprice,0.0)" in plan and "IsNotNull(l_suppkey)" in plan
    assert "l_partkey" not in plan and "BroadcastHashJoin" in plan


def test_scan_of_all_patterns_reads_once(spark, small):
    plan = plan_of(QUERIES["pii_scan"](spark, small))
    assert plan.count("FileScan") == 1


def test_latest_row_is_cut_down_before_the_shuffle(spark, small):
    plan = plan_of(QUERIES["history_latest"](spark, small))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_recent_is_a_top_k(spark, small):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["history_recent"](spark, small))
