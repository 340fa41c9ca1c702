"""Physical-plan checks: no nested-loop / cartesian joins where a rewrite exists, no
Python evaluation in batch operators, filters pushed to the scan."""

import pytest

from conftest import SMALL
from hotspot.plans import all_queries

BAD_JOINS = ("BroadcastNestedLoopJoin", "CartesianProduct")
PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "FlatMapGroupsInPandasWithState")
LAZY_KEYS = [
    "assign_projects", "frp_cumulative", "frame_counts", "frames_join", "frontier", "daily_runout", "weekly_counts",
    "count_kpis", "merge_detections", "extent", "report_kpis", "running_count", "ticks_join", "request_manifest",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", LAZY_KEYS)
def test_no_nested_loop_or_python(spark, key):
    p = plan(all_queries()[key](spark, SMALL))
    for bad in BAD_JOINS + PY_NODES:
        assert bad not in p, (key, bad)


def test_frontier_windows_share_one_exchange(spark):
    import re

    from hotspot.operators import frontier as fr

    daily = spark.createDataFrame([], "project_id bigint, date_only date, satellite string, distance_km double")
    p = plan(fr.frontier(daily))
    assert len(re.findall(r"Exchange hashpartitioning\(project_id#\d+L?, \d+\)", p)) == 1


def test_filter_and_projection_reach_the_scan(spark, tmp_path):
    from pyspark.sql import functions as F

    from hotspot.sources import fixtures as fx

    path = str(tmp_path / "det")
    fx.detections_ev(spark, SMALL).write.partitionBy("project_id").parquet(path)
    df = spark.read.parquet(path).where((F.col("project_id") == 1) & (F.col("frp") > 100.0)).select("detection_id")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(frp), GreaterThan(frp,100.0)]" in p
    assert "PartitionFilters: [isnotnull(project_id" in p
    assert "ReadSchema: struct<detection_id:bigint,frp:double>" in p


@pytest.mark.parametrize("key", ["daily_runout", "frontier", "merge_detections", "weekly_counts", "frp_cumulative"])
def test_hot_aggregates_are_hash_based(spark, key):
    """The aggregates over the largest inputs must not fall back to a sort-based aggregate."""
    assert "SortAggregate" not in plan(all_queries()[key](spark, SMALL))
