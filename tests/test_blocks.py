"""Every ordered operator must not depend on where a run is cut into blocks."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runlens import views
from runlens.operators import aggregates, fitting, joins, windows
from runlens.plans import blocks
from runlens.sources import specs

TINY = 5


def table(df):
    df = df.select(sorted(df.columns))
    numeric = [f.name for f in df.schema if f.dataType.simpleString() == "double"]
    return sorted(map(str, (tuple(r) for r in df.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in numeric}).collect())))


@pytest.fixture(scope="module")
def hot(spark, small):
    """One run that holds more than a third of the rows, beside small ones."""
    rows = views.sensor_view(spark, small).withColumn("run_id", F.when(F.col("run_id") < 6, F.lit(0)).otherwise(F.col("run_id")))
    numbered = blocks.number_rows(rows.drop("seq"), ["run_id"], ["t", "event_id"], "seq")
    pdf = numbered.select("run_id", "seq", "t", "metric", "value").toPandas()
    assert (pdf.run_id == 0).mean() > 0.3
    return spark.createDataFrame(pdf, "run_id long, seq long, t double, metric string, value double").cache()


CASES = {
    "interpolate": lambda s, b: windows.interpolate(s, ["ambient", "cpu_0_temp"], block_rows=b),
    "clamped": lambda s, b: windows.interp_clamped(s, ["ambient"], block_rows=b),
    "ffill": lambda s, b: windows.ffill_bfill(s, ["cam_cpu"], block_rows=b),
    "smooth": lambda s, b: windows.smooth(s, 4, b),
    "smooth_wide": lambda s, b: windows.smooth(s, 12, b),
    "ops": lambda s, b: windows.ops_per_sec(s, block_rows=b),
    "ops_decimated": lambda s, b: windows.ops_per_sec(s, decimate_by=3, block_rows=b),
    "low_pass": lambda s, b: windows.low_pass(s, 10, 333, block_rows=b),
    "low_pass_strong": lambda s, b: windows.low_pass(s, 10, 0.5, y0=3.0, block_rows=b),
    "energy": lambda s, b: windows.energy(s, block_rows=b),
    "throttle": lambda s, b: windows.throttle(s, 86400, b),
    "subtract": lambda s, b: joins.subtract(s, ["cpu_0_temp"], "ambient", b),
    "subtract_clamped": lambda s, b: joins.subtract_clamped(s, "cpu_0_temp", "ambient", block_rows=b),
    "sync": lambda s, b: joins.sync_sample(s, s.where("metric = 'ambient'").select("run_id", "t"), ["cpu_0_temp", "cam_cpu"], b),
    "thermocam": lambda s, b: joins.thermocam_correct(s, block_rows=b),
}


@pytest.mark.parametrize("name", CASES)
def test_cuts_do_not_matter(hot, name):
    assert table(CASES[name](hot, TINY)) == table(CASES[name](hot, blocks.BLOCK_ROWS))


@pytest.fixture(params=[1, 7, 60])
def ranges(spark, request):
    """As many ranges, however small, so that runs are cut."""
    settings = {"spark.sql.shuffle.partitions": str(request.param), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    saved = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in saved.items():
        spark.conf.set(k, v)


def test_number_rows_over_ranges(hot, ranges):
    order = ["t", "metric", "value"]
    plain = hot.drop("seq").withColumn("n", F.row_number().over(W.partitionBy("run_id").orderBy(*order)).cast("long") - 1)
    assert table(blocks.number_rows(hot.drop("seq"), ["run_id"], order, "n")) == table(plain)


def test_quantiles_over_ranges(hot, ranges):
    pdf = hot.toPandas()
    got = aggregates.quantiles(hot, "value", [0.1, 0.5, 0.75], ["metric"]).toPandas().set_index("metric")
    want = pdf.groupby("metric").value.quantile([0.1, 0.5, 0.75]).unstack()
    np.testing.assert_allclose(got.sort_index().to_numpy(), want.sort_index().to_numpy(), rtol=1e-12)
    assert aggregates.quantiles(hot, "value", [0.25]).first().q0 == pytest.approx(pdf.value.quantile(0.25), rel=1e-12)


def test_views_over_ranges(spark, small):
    assert table(views.sensor_view(spark, small, 50)) == table(views.sensor_view(spark, small))
    assert table(views.counter_view(spark, small, 50)) == table(views.counter_view(spark, small))


@pytest.mark.parametrize("decay", [0.0, 0.2, 0.9, 0.999])
def test_affine_scan_follows_the_recurrence(spark, decay):
    u = np.random.default_rng(3).normal(size=500)
    df = spark.createDataFrame([("a", i, float(x), 2.0) for i, x in enumerate(u)], "k string, pos long, u double, y0 double")
    y, want = 2.0, []
    for x in u:
        y = decay * y + x
        want.append(y)
    for rows in (7, 64, 10_000):
        got = [r.y for r in blocks.affine_scan(df, ["k"], "pos", "u", decay, "y0", "y", rows).orderBy("pos").collect()]
        np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("decay", [0.05, 0.5, 1e-40, 1e-200])
def test_nothing_is_cut_off_a_fading_value(spark, decay):
    df = spark.createDataFrame([("a", i, 1e30 if i == 0 else 0.0, 0.0) for i in range(400)], "k string, pos long, u double, y0 double")
    got = [r.y for r in blocks.affine_scan(df, ["k"], "pos", "u", decay, "y0", "y", 4).orderBy("pos").collect()]
    y, want = 0.0, []
    for i in range(400):
        y = decay * y + (1e30 if i == 0 else 0.0)
        want.append(y)
    for g, w in zip(got, want):
        assert g == pytest.approx(w, rel=1e-9, abs=1e-280)


def test_specs_over_blocks(spark, hot):
    rows = [("0", 0, "cpu_0_temp", 0.5, "CPU", None, None, 4), ("0", 1, "cpu_1_temp", 1.0, "B", "ambient", 0.25, None), ("7", 2, "cam_cpu", 2.0, "C", "ambient", 1.0, 3)]
    spec = spark.createDataFrame(rows, "data_path string, spec_no int, y_col_name string, y_scale double, y_label string, y_subtract string, y_subtract_scale double, smoothing_window_size int").withColumn("x_scale", F.lit(1.0))
    samples = hot.withColumn("run_id", F.col("run_id").cast("string"))
    assert table(specs.apply_specs(samples, spec, TINY)) == table(specs.apply_specs(samples, spec))


def test_attach_reaches_every_block(spark):
    df = spark.range(100).select(F.lit("a").alias("k"), F.col("id").alias("seq"))
    per = df.groupBy("k").agg(F.sum("seq").alias("s"), blocks.last_seq())
    out = blocks.attach(df, per, ["k"], block_rows=7)
    assert out.count() == 100 and out.select("s").distinct().count() == 1


NULL_CASES = CASES | {
    "decimate": lambda s, b: windows.decimate(s, 3, b),
    "decimate_ends": lambda s, b: windows.decimate(s, 0, b),
    "position": lambda s, b: windows.position(s, "pos", b),
    "number_rows": lambda s, b: blocks.number_rows(s.drop("seq"), ["run_id"], ["t", "metric", "value"], "seq"),
    "align": lambda s, b: joins.align_runs(s, "t", "cpu_0_temp"),
    "ops_est": lambda s, b: aggregates.ops_est(s, block_rows=b),
    "mean_speed": lambda s, b: aggregates.mean_speed(s, block_rows=b),
    "fit": lambda s, b: fitting.fit(s.withColumn("t", F.col("t") / 3600), 1, rounds=2, points=6).drop("terms"),
    "sweep": lambda s, b: fitting.fit_sweep(s.withColumn("t", F.col("t") / 3600), [300, 700], 1, rounds=1, points=5).drop("terms"),
    "residuals": lambda s, b: fitting.residuals(s, fitting.fit(s, 1, rounds=0, taus=[1e3]), b),
    "coverage": lambda s, b: aggregates.coverage(s, {"temp": "T", "cam": "C"}, ["ambient"]),
}


@pytest.mark.parametrize("name", NULL_CASES)
def test_runs_and_metrics_without_a_name(hot, name):
    """A run whose key is NULL is treated as any other run; so is a metric without a name."""
    unnamed = hot.withColumn("run_id", F.when(F.col("run_id") != 0, F.col("run_id")))
    named = lambda df: df.withColumn("run_id", F.coalesce("run_id", F.lit(0).cast("long")))
    got = NULL_CASES[name](unnamed, TINY)
    assert got.where("run_id IS NULL").count() > 0
    assert table(named(got)) == table(NULL_CASES[name](hot, TINY))


def test_series_without_a_metric(hot):
    unnamed = hot.withColumn("metric", F.when(F.col("metric") != "ambient", F.col("metric")))
    for name in ("smooth", "energy", "low_pass", "throttle"):
        got = CASES[name](unnamed, TINY).drop("label").withColumn("metric", F.coalesce("metric", F.lit("ambient")))
        assert table(got) == table(CASES[name](hot, TINY).drop("label"))


def test_throttle_catches_up(spark):
    """The mark moves on by one period per row, so rows come closer after a gap; a step back in time is passed over."""
    rows = [("a", i, float(t), "m", float(i)) for i, t in enumerate([0, 1, 2, 3, 4, 5, 12, 13, 14])]
    rows += [("b", i, t, "m", 1.0) for i, t in enumerate([0.0, 5.0, 4.0, 4.5, 5.0, 6.0, 6.1, 30.0])] + [("c", 0, 7.0, "m", 1.0), ("d", 0, 1.0, "m", None)]
    df = spark.createDataFrame(rows, "run_id string, seq long, t double, metric string, value double")
    for b in (1, 2, 3, 100):
        got = windows.throttle(df, 2.0, b).orderBy("seq").collect()
        assert [r.t for r in got if r.run_id == "a"] == [3.0, 5.0, 12.0, 13.0, 14.0]
        assert [(r.seq, r.t) for r in got if r.run_id == "b"] == [(1, 5.0), (4, 5.0), (6, 6.1), (7, 30.0)]
        assert {r.run_id for r in got} == {"a", "b"}


def test_throttle_follows_the_loop(spark):
    rng = np.random.default_rng(8)
    t = np.cumsum(rng.choice([0.0, 0.1, 0.3, 0.7, 5.0], 400))
    df = spark.createDataFrame([("a", i, float(x), "m", 1.0) for i, x in enumerate(t)], "run_id string, seq long, t double, metric string, value double")
    moved, want = 0, []
    for i, x in enumerate(t):
        if x > t[0] + (moved + 1) * 0.7:
            moved += 1
            want.append(i)
    for b in (3, 50, 1000):
        assert [r.seq for r in windows.throttle(df, 0.7, b).orderBy("seq").collect()] == want


def test_histogram_counts_every_value(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, float("inf"), float("inf"), float("-inf"), float("nan"), None)], "v double")
    got = {r.bin: r.n for r in aggregates.histogram(df, "v", 2).collect()}
    assert got == {0: 1, 1: 2, 2: 2, -1: 1, None: 1}
    same = aggregates.histogram(df.where("v = 2"), "v", 3).collect()
    assert [r.n for r in same] == [1, 0, 0]


def test_wide_alignment_is_a_full_outer_join_of_any_number_of_runs(hot):
    long = joins.align_runs(hot, "t", "cpu_0_temp").toPandas()
    want = long.pivot(index="x", columns="run_id", values="value").sort_index()
    for width in (1, 4, 500):
        got = joins.align_runs_wide(hot, "t", "cpu_0_temp", width=width).toPandas().set_index("x").sort_index()
        assert list(got.columns) == [f"run_{r}" for r in want.columns]
        np.testing.assert_array_equal(got.to_numpy(float), want.to_numpy(float))


def test_packed_alignment_has_every_cell_of_the_wide_one(spark, hot):
    wide = joins.align_runs_wide(hot, "t", "cpu_0_temp").toPandas().set_index("x")
    want = {(x, c): None if v != v else v for c in wide.columns for x, v in wide[c].items()}
    for width in (1, 4, 500):
        blocks = joins.align_runs_wide(hot, "t", "cpu_0_temp", width=width, packed=True).collect()
        assert all(len(r["runs"]) <= width for r in blocks)
        assert {(r.x, f"run_{i}"): v for r in blocks for i, v in zip(r["runs"], r["values"])} == want


def test_packed_alignment_of_given_and_unnamed_runs(spark):
    rows = [(1, 0, 0.0, "v", 5.0), (1, 1, 1.0, "v", None), (None, 0, 1.0, "v", 6.0), (2, 0, 2.0, "v", 7.0)]
    df = spark.createDataFrame(rows, "run_id long, seq long, t double, metric string, value double")
    got = {(r.x, i): v for r in joins.align_runs_wide(df, "t", "v", packed=True).collect() for i, v in zip(r["runs"], r["values"])}
    assert got == {(x, i): {(0.0, 1): 5.0, (1.0, None): 6.0, (2.0, 2): 7.0}.get((x, i)) for x in (0.0, 1.0, 2.0) for i in (None, 1, 2)}
