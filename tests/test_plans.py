"""Plans that have to hold at scale."""

import re

import pytest

from runlens import views
from runlens.operators import fitting, joins, windows
from runlens.plans.scratch import written


@pytest.fixture(scope="module")
def stored(spark, small):
    return written(views.sensor_view(spark, small).drop("event_id"), "samples")


def plan(df):
    spark = df.sparkSession
    saved = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", saved)


CASES = {
    "interpolate": lambda s: windows.interpolate(s, ["ambient", "cpu_0_temp"]),
    "ops_per_sec": windows.ops_per_sec,
    "energy": windows.energy,
    "throttle": lambda s: windows.throttle(s, 100.0),
    "subtract": lambda s: joins.subtract(s, ["cpu_0_temp"], "ambient"),
    "moments": lambda s: fitting.summarize(s, ["run_id", "metric"], 1.0),
    "align": lambda s: joins.align_runs(s, "t", "cpu_0_temp"),
}


@pytest.mark.parametrize("name", CASES)
def test_samples_are_aggregated_by_hash(stored, name):
    text = plan(CASES[name](stored))
    assert "SortAggregate" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


@pytest.mark.parametrize("name", CASES)
def test_no_window_takes_a_whole_run_of_rows(stored, name):
    """A window over rows is split by block; one over a run alone sees block rows only."""
    for line in plan(CASES[name](stored)).splitlines():
        if "Window [" in line and "_edge" not in line:
            spec = re.search(r"windowspecdefinition\(([^)]*)", line).group(1)
            assert "_block" in spec, line


def test_wide_scan_shuffles_the_rows_once(stored):
    text = plan(windows.interpolate(stored, ["ambient", "cpu_0_temp"]))
    assert text.count("FileScan") == 1 and "ReusedExchange" in text


def test_metric_filter_reaches_the_scan(stored):
    text = plan(joins.subtract(stored, ["cpu_0_temp"], "ambient"))
    assert re.search(r"PushedFilters: \[[^\]]*In\(metric", text)
    narrow = plan(windows.ops_per_sec(stored))
    assert "StringContains(metric,work_done)" in narrow or "RLIKE" in narrow


def test_moments_take_one_pass(stored):
    text = plan(fitting.summarize(stored, ["run_id", "metric"], 1.0))
    assert text.count("FileScan") == 1 and len(re.findall("Exchange hash", text)) == 1
