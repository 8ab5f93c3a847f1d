"""Physical-plan checks: the plans we want, not just right answers."""

import re

import __spark_entry__ as E
from tests.conftest import SF01


def _plan(spark, name):
    df = E.queries()[name](spark, SF01)
    return df._jdf.queryExecution().executedPlan().toString()


def test_hourly_pivot_is_two_hash_aggregations(spark):
    p = _plan(spark, "hourly_wide")
    assert p.count("Exchange hashpartitioning") == 2
    assert "SortAggregate" not in p and "ObjectHashAggregate" not in p
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in p \
        or "props" not in p.split("ReadSchema")[1].split("\n")[0]


def test_snapshot_broadcasts_the_dimension_and_stays_in_the_jvm(spark):
    p = _plan(spark, "aqi_snapshot")
    assert "BroadcastHashJoin" in p
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in p
    assert "PushedFilters: [IsNotNull(value)" in p


def test_feature_windows_share_sorts(spark):
    p = _plan(spark, "lags_all")
    assert p.count("Sort [") == 2          # ascending (lags, position, forward fill) + reversed (next known)
    assert len(re.findall(r"hashpartitioning\(location#\d+L?, \d+\)", p)) == 1   # one exchange for all windows


def test_no_cartesian_products_anywhere(spark):
    for name in ("listing_classify", "missing_months", "forecast_fixed_coefs", "midpoint_pairs", "kpi_4weekly"):
        p = _plan(spark, name)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_bucketed_series_windows_skip_the_exchange(spark):
    p = _plan(spark, "bucketed_series_lags")
    window_part = p.split("Window [")[1] if "Window [" in p else ""
    assert "Window [" in p and "Exchange" not in window_part
