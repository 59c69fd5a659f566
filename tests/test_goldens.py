"""Known results that need no files."""

import math

import pytest
from pyspark.sql import functions as F

from runlens.functions import numbers
from runlens.functions.text import common_prefix, common_suffix, fit_text
from runlens.operators import aggregates, columns, fitting, joins, lines, windows
from runlens.plans.grids import expand_bounds
from runlens.sources.runfiles import csv_cell, split_cells


def samples(spark, rows):
    """rows of (run, seq, t, {metric: value})"""
    flat = [(r, s, float(t), m, None if v is None else float(v)) for r, s, t, cells in rows for m, v in cells.items()]
    return spark.createDataFrame(flat, "run_id string, seq long, t double, metric string, value double")


def series(spark, metric, points, run="r"):
    return samples(spark, [(run, i, t, {metric: v}) for i, (t, v) in enumerate(points)])


def test_interpolate(spark):
    df = series(spark, "v", [(0, 0), (1, None), (2, None), (3, None), (1000, 1000), (1001, None)])
    got = [r.value for r in windows.interpolate(df, ["v"]).orderBy("seq").collect()]
    assert got == [0, 1, 2, 3, 1000, None]
    assert [r.value for r in windows.interp_clamped(df, ["v"]).orderBy("seq").collect()] == [0, 1, 2, 3, 1000, 1000]
    df = series(spark, "v", [(0, 1), (1, None), (2, 2)])
    assert [r.value for r in windows.interpolate(df, ["v"]).orderBy("seq").collect()] == [1, 1.5, 2]


def test_equal_times_do_not_fail(spark):
    df = series(spark, "v", [(1, 1), (1, None), (1, 3)])
    assert [r.value for r in windows.interpolate(df, ["v"]).orderBy("seq").collect()] == [1, None, 3]


def test_ops_per_sec(spark):
    df = series(spark, "work_done", [(1, 1), (1, 2), (2, 3)])
    assert [r.ops for r in windows.ops_per_sec(df).orderBy("seq").collect()] == [math.inf, 1.0]
    assert [r.ops for r in windows.ops_per_sec(df, drop_inf=True).collect()] == [1.0]
    assert [r.ops for r in windows.ops_per_sec(df, decimate_by=0).collect()] == [2.0]


def test_ops_est_of_one_speed_is_unsure(spark):
    df = series(spark, "work_done", [(0, 0), (2, 3)])
    row = aggregates.ops_est(df).first()
    assert row.ops == 1.5 and row.ops_err == math.inf


def test_mean_est(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    row = aggregates.mean_estimate(df, [], "x").first()
    assert row.val == 2.0 and round(row.err, 1) == 4.3


@pytest.mark.parametrize("dof,value", [(1, 12.7062047), (2, 4.3026527), (3, 3.1824463), (10, 2.2281389), (30, 2.0422725), (200, 1.9718962)])
def test_t_quantile(dof, value):
    assert numbers.t_quantile(dof) == pytest.approx(value, abs=1e-6)


def test_t_series_meets_the_table(spark):
    df = spark.range(150, 260).select(numbers.t_critical(F.col("id")).alias("t"), "id")
    for row in df.collect():
        assert row.t == pytest.approx(numbers.t_quantile(row.id), abs=1e-9)


def test_fit_golden(spark):
    df = series(spark, "temp", zip(range(0, 60, 10), [0, 6, 6.5, 6.8, 7, 7]))
    row = fitting.legend(fitting.fit(df, 2)).first()
    assert row.text == "7.1 – 5.0⋅e^{−t/1.0} – 2.1⋅e^{−t/16.1}"
    doubled = fitting.fit(df, 2, compat_rmse=True).first()
    assert doubled.rmse == pytest.approx(2 * row.rmse)


def test_fit_text(spark):
    df = spark.createDataFrame([(50.0, [(3.0, 600.0), (-2.0, 1.2)])], "tinf double, terms array<struct<k:double,tau:double>>")
    out = df.select(fit_text(F.col("tinf"), F.col("terms")).alias("s"), fit_text(F.col("tinf"), F.col("terms"), True).alias("m"),
                    fit_text(F.col("tinf"), F.col("terms"), False, "latex").alias("x")).first()
    assert out.s == "50.0 – 2.0⋅e^{−t/1.2} + 3.0⋅e^{−t/600.0}"
    assert out.m == "50.0 – 2.0⋅e^{−t/0.02} + 3.0⋅e^{−t/10.0}"
    assert out.x == r"50.0-2.0 e^{\frac{-t}{1.2}} + 3.0 e^{\frac{-t}{600.0}}"


def test_csv_cells(spark):
    df = spark.createDataFrame([("plain",), ("comma,comma",), ('quote"quote',), ("line\rbreak",)], "v string")
    got = [r[0] for r in df.select(csv_cell(F.col("v"))).collect()]
    assert got == ["plain", '"comma,comma"', '"quote""quote"', '"line\rbreak"']
    line = spark.createDataFrame([('1,,"a ""x"", b",,"",z,',)], "v string")
    assert line.select(split_cells(F.col("v"))).first()[0] == ["1", "", 'a "x", b', "", "", "z", ""]


def test_prefix_and_suffix(spark):
    df = spark.createDataFrame([("hot.1.csv",), ("hot.12.csv",), ("hot.2.csv",)], "n string")
    assert tuple(df.agg(common_prefix(F.col("n")), common_suffix(F.col("n"))).first()) == ("hot.", ".csv")
    one = df.limit(1)
    assert one.agg(common_prefix(F.col("n"))).first()[0] == one.first()[0]


def test_general_format(spark):
    values = [0.0, 1.0, -2.5, 123456.0, 1234567.0, 999999.5, 0.0001, 0.00001234, 1e10, 100.0, 3.14159265, 1e-300, 2e300, math.inf, math.nan]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = [r[0] for r in df.select(numbers.general_format(F.col("v"))).collect()]
    assert got == ["%g" % v for v in values]


def test_names(spark):
    df = spark.createDataFrame([("time/ms",), ("CPU_0_temp/m°C",), ("CPU0_load/%",), ("4V0_WIFI_power/mW",)], "raw_name string")
    got = [r[0] for r in df.select(columns.normalized_name(F.col("raw_name"))).collect()]
    assert got == ["time_ms", "CPU_0_temp_m°C", "CPU0_load_", "_4V0_WIFI_power_mW"]
    df = spark.createDataFrame([("time_s",), ("CPU_0_temp_°C",), ("f_Hz",), ("plain",)], "name string")
    assert [r.name for r in columns.strip_units(df).collect()] == ["time", "CPU_0_temp", "f", "plain"]


def test_specs_are_checked():
    assert lines.parse_specs(["@a=", "b=", "rest"])[0] == lines.Spec("a", "a", True)
    with pytest.raises(ValueError):
        lines.parse_specs(["other", "other2"])
    with pytest.raises(ValueError):
        lines.parse_specs([])


def packed(spark, texts, specs, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq long, line string").withColumn("b", F.lit(0))
    rows = lines.pack_rows(lines.parse_lines(df, specs, **options), ["b"], flush_unmatched="stdout" in options).orderBy("row_no").collect()
    return [r.cells for r in rows]


def test_pack_rows(spark):
    assert packed(spark, ["key1=value1", "key2=value2"], ["key1=", "key2="]) == [{"key1": "value1", "key2": "value2"}]
    assert packed(spark, ["other", "key=val"], ["other", "key="]) == [{"other": "other", "key": "val"}]
    assert packed(spark, ["other", "key=val"], ["key="]) == [{"key": "val"}]
    assert packed(spark, ["other", "key2=val2", "key1=val1"], ["other", "key1=", "key2="]) == [{"other": "other", "key1": "val1", "key2": "val2"}]
    # greedy: a,b,b,b,a
    assert packed(spark, ["a=1", "b=2", "b=3", "b=4", "a=5"], ["a=", "b="]) == [{"a": "1", "b": "2"}, {"b": "3"}, {"b": "4", "a": "5"}]
    # a whole line closes its row; an empty value does not start one
    assert packed(spark, ["a=1", "hello", "a=2"], ["a="], stdout="stdout") == [{"a": "1", "stdout": "hello"}, {"a": "2"}]
    assert packed(spark, ["a=", "a=2\r"], ["a="]) == [{"a": "2"}]


def test_cpu_load_wraps(spark):
    zero = dict.fromkeys(windows.COUNTERS, 0)
    rows = [{"run_id": "r", "cpu": 1, "seq": 0, "t": 0.0, **zero, "user": 2**32 - 10, "idle": 5}, {"run_id": "r", "cpu": 1, "seq": 1, "t": 1.0, **zero, "user": 20, "idle": 15},
            {"run_id": "r", "cpu": 1, "seq": 2, "t": 2.0, **zero, "user": 20, "idle": 15}]
    types = ", ".join(["run_id string", "cpu int", "seq long", "t double", *[f"{c} long" for c in windows.COUNTERS]])
    got = windows.cpu_load(spark.createDataFrame(rows, types)).orderBy("seq").collect()
    assert [r.load for r in got] == [75.0, 0.0] and got[0].metric == "CPU1_load/%"


def test_align_keeps_the_last_of_equal_x(spark):
    df = samples(spark, [("a", 0, 1, {"m": 1}), ("a", 1, 1, {"m": 2}), ("b", 0, 2, {"m": 3})])
    got = {r.x: (r.run_a, r.run_b) for r in joins.align_runs(df, "t", "m", ["a", "b"]).collect()}
    assert got == {1.0: (2.0, None), 2.0: (None, 3.0)}


def test_compare_pairs_by_name(spark):
    schema = "name string, metric string, tinf double, subtract boolean"
    one = spark.createDataFrame([("a", "m", 1.0, False), ("b", "m", 2.0, False)], schema)
    two = spark.createDataFrame([("b", "m", 3.0, False), ("c", "m", 4.0, False)], schema)
    got = {r.name: (r.tinf_1, r.tinf_2) for r in joins.compare_tinf(one, two).collect()}
    assert got == {"a": (1.0, None), "b": (2.0, 3.0), "c": (None, 4.0)}
    with pytest.raises(Exception, match="differ in subtract"):
        joins.compare_tinf(one, one.withColumn("subtract", F.lit(True))).collect()


def test_two_digits_as_printed(spark):
    values = [0.0031, 12.34, 0.31, 1.0, 99.6, 123.0, 0.00001, 0.0]
    got = [r.s for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(numbers.general_format(F.col("v"), 2).alias("s")).collect()]
    assert got == ["%.2g" % v for v in values]


def test_titles_carry_the_row_number_where_names_and_columns_differ(spark):
    fits = spark.createDataFrame([("a", "x"), ("b", "y")], "name string, metric string")
    assert sorted(r.title for r in columns.series_titles(fits).collect()) == ["a, x1", "b, y2"]
    assert sorted(r.title for r in columns.series_titles(fits.withColumn("metric", F.lit("x"))).collect()) == ["a", "b"]


def test_only_the_time_column_is_in_milliseconds(spark):
    df = spark.createDataFrame([("lat", "ms", 5000.0), ("temp", "mC", 40000.0)], "metric string, unit string, value double")
    assert {(r.metric, r.unit, r.value) for r in columns.normalize_units(df).collect()} == {("lat", "ms", 5000.0), ("temp", "°C", 40.0)}


def test_bounds_repeat():
    assert expand_bounds([(1, 2), (3, 4)], 3) == [(1.0, 2.0), (3.0, 4.0), (3.0, 4.0)]
