"""The shape of the physical plans: what must not be planned, and what must."""

import re

import pytest

from tallygrain.plans import load_all
from tallygrain.registry import QUERIES
from tests.conftest import SF

load_all()
STREAMS = {"event_stream", "throughput_tumbling", "throughput_sliding", "activity_last_hour", "device_state",
           "login_state", "late_events", "change_feed_apply", "event_publish_stream"}


@pytest.fixture()
def unbroadcast(spark):
    """Plans as they are when no side is small."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# tables of one row per day, run or block by the time one task orders them
SMALL_WINDOWS = {"sh_moving_average", "percent_change", "run_trend", "assign_ids", "add_customer_bundle"}


@pytest.mark.parametrize("key", sorted(set(QUERIES) - STREAMS))
def test_plan_scales(unbroadcast, key):
    text = plan(QUERIES[key](unbroadcast, SF))
    for pairs_or_python in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert pairs_or_python not in text
    whole_in_one_task = re.search(r"Window \[[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", text)
    assert key in SMALL_WINDOWS or not whole_in_one_task


@pytest.mark.parametrize("key", ["rank_global", "bounded_browse", "rank_in_partition", "oe_browse_products", "oe_browse_customer"])
def test_rankings_are_limited_before_the_shuffle(spark, key):
    text = plan(QUERIES[key](spark, SF))
    assert re.search(r"WindowGroupLimit .*Partial", text)


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["between_filter"](spark, SF))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,10.0), LessThanOrEqual(l_quantity,20.0)]" in text
    schema = re.search(r"ReadSchema: (\S+)", text).group(1)
    assert schema.count(":") == 4


def test_reports_by_product_do_not_read_orders(spark):
    assert "orders.parquet" not in plan(QUERIES["sh_product_monthly_rollup"](spark, SF))


@pytest.mark.parametrize("key", ["sh_period_to_period", "sh_cube_month_chosen", "sh_rollup_week_chosen", "sh_product_rollup_chosen"])
def test_chosen_dates_reach_every_scan_of_the_lines(spark, key):
    scans = [line for line in plan(QUERIES[key](spark, SF)).splitlines() if "FileScan" in line and "lineitem.parquet" in line]
    assert scans
    for scan in scans:
        pushed = scan.split("PushedFilters: ")[1]
        assert "GreaterThanOrEqual(l_shipdate" in pushed and "LessThan(l_shipda" in pushed
