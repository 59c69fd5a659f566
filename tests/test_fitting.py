"""Fits of generated series with known parameters, and the box solver."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.functions.boxed import solve_boxed
from runlens.functions.exponentials import Bins, grid_best, refined
from runlens.operators import fitting
from runlens.plans.grids import K_BOUNDS, T_BOUNDS, TAU_BOUNDS, expand_bounds, tau_tuples

TRUTH = {
    1: [(40.0, [(-10.0, 100.0)])],
    2: [(53.0, [(-8.16, 59.4), (-13.1, 317.6)]), (30.0, [(12.0, 20.0), (5.0, 400.0)])],
    3: [(60.0, [(-5.0, 10.0), (-10.0, 100.0), (-8.0, 900.0)])],
}


def generated(spark, cases, noise=0.01, n=1800, shift=0.0):
    rng = np.random.default_rng(5)
    rows = []
    for c, (tinf, terms) in enumerate(cases):
        t = np.arange(n, dtype=float)
        y = tinf + sum(k * np.exp(-t / tau) for k, tau in terms) + rng.normal(0, noise, n)
        rows += [(f"run{c}", i, float(a + shift), "temp", float(b)) for i, (a, b) in enumerate(zip(t, y))]
    return spark.createDataFrame(rows, "run_id string, seq long, t double, metric string, value double")


@pytest.mark.parametrize("order", [1, 2, 3])
def test_recovers_the_truth(spark, order):
    got = fitting.fit(generated(spark, TRUTH[order]), order).orderBy("run_id").collect()
    for row, (tinf, terms) in zip(got, TRUTH[order]):
        assert row.tinf == pytest.approx(tinf, abs=0.05)
        assert row.rmse == pytest.approx(0.01, rel=0.2)
        for term, (k, tau) in zip(row.terms, terms):
            assert term.tau == pytest.approx(tau, rel=0.03) and term.k == pytest.approx(k, abs=0.3)


def test_quick_fit_ignores_the_start_time(spark):
    plain = fitting.fit_quick(generated(spark, TRUTH[1]), 1).first()
    moved = fitting.fit_quick(generated(spark, TRUTH[1], shift=500.0), 1).first()
    assert moved.tinf == pytest.approx(plain.tinf, abs=1e-6)
    assert fitting.fit(generated(spark, TRUTH[1], shift=50.0), 1).first().terms[0].k == pytest.approx(-10 * np.exp(0.5), rel=0.01)


def test_moments_equal_the_raw_sums(spark):
    df = generated(spark, TRUTH[2], noise=0.5)
    fits = fitting.fit(df, 2, rounds=0, taus=[5.0, 60.0, 300.0, 1500.0], k_bounds=[(-np.inf, np.inf)], t_bounds=(-np.inf, np.inf))
    sums = fitting.residuals(df, fits).groupBy("run_id").agg(F.sum(F.col("residual") ** 2).alias("rss")).orderBy("run_id").collect()
    for a, b in zip(fits.orderBy("run_id").collect(), sums):
        assert a.rss == pytest.approx(b.rss, rel=1e-9)


def test_short_series_give_no_fit(spark):
    row = fitting.fit(generated(spark, TRUTH[1], n=5), 2).first()
    assert row.n == 5 and row.tinf is None and row.rmse is None


def test_bounds_hold_and_fit_is_best_inside(spark):
    df = generated(spark, TRUTH[2][:1])
    row = fitting.fit(df, 2, tau_bounds=[(30, 120), (600, 1200)], k_bounds=[(-10, 10), (-5, 5)], t_bounds=(30, 50)).first()
    assert 30 <= row.tinf <= 50 and row.terms[0].tau <= 120.0 + 1e-9 and 600 <= row.terms[1].tau <= 1200
    assert abs(row.terms[0].k) <= 10 + 1e-6 and abs(row.terms[1].k) <= 5 + 1e-6


def test_solver_against_sampling():
    rng = np.random.default_rng(2)
    boxes = [(0.0, 1.0), (-1.0, 1.0), (-0.5, 2.0)]
    x = rng.normal(size=(20, 30, 3))
    y = rng.normal(size=(20, 30)) * 3
    a, b, yy = np.einsum("npi,npj->nij", x, x), np.einsum("npi,np->ni", x, y), (y * y).sum(1)
    v, rss = solve_boxed(a, b, yy, boxes)
    grid = np.array(list(itertools.product(*[np.linspace(lo, hi, 21) for lo, hi in boxes])))
    for i in range(20):
        tried = yy[i] - 2 * grid @ b[i] + np.einsum("gi,ij,gj->g", grid, a[i], grid)
        assert rss[i] <= tried.min() + 1e-9
        assert rss[i] == pytest.approx(((y[i] - x[i] @ v[i]) ** 2).sum())


def test_sweep_equals_separate_fits(spark):
    df = generated(spark, TRUTH[1], n=600)
    swept = {r.horizon: r for r in fitting.fit_sweep(df, [100, 300, 600], 1, rounds=2).collect()}
    for h, row in swept.items():
        alone = fitting.fit(df.where(F.col("t") < h), 1, rounds=2).first()
        assert row.n == alone.n and row.tinf == pytest.approx(alone.tinf, abs=1e-6)


def test_refit_stays_near(spark):
    df = generated(spark, TRUTH[1])
    first = fitting.fit(df, 1, rounds=0)
    again = fitting.refit_around(df, first, 1, 0.05).first()
    start = first.first()
    assert abs(again.terms[0].tau / start.terms[0].tau - 1) <= 0.05 + 1e-9 and again.rss <= start.rss + 1e-9


def test_refit_of_a_small_tau(spark):
    t = np.arange(0, 0.4, 0.0005)
    rows = [("r", i, float(a), "m", float(20 - 5 * np.exp(-a / 0.02))) for i, a in enumerate(t)]
    df = spark.createDataFrame(rows, "run_id string, seq long, t double, metric string, value double")
    first = fitting.fit(df, 1, tau_bounds=[(0.001, 1)], taus=[0.0203], rounds=0)
    again = fitting.refit_around(df, first, 1, 0.05).first()
    assert again.terms[0].tau == pytest.approx(0.02, rel=1e-3) and again.tinf == pytest.approx(20, abs=1e-3)


def test_errors(spark):
    df = generated(spark, TRUTH[1])
    fits = fitting.fit(df, 1)
    assumed = fitting.parameter_errors(df, fits, 1, "assumed_sigma").first()
    t = np.arange(1800.0)
    e = np.exp(-t / 100)
    j = np.column_stack([np.ones_like(t), e, -10 * t * e / 100**2])
    want = 0.5 * np.sqrt(np.diag(np.linalg.inv(j.T @ j)))
    assert assumed.tinf_err == pytest.approx(want[0], rel=0.01)
    assert assumed.terms[0].k_err == pytest.approx(want[1], rel=0.01) and assumed.terms[0].tau_err == pytest.approx(want[2], rel=0.01)
    margin = fitting.parameter_errors(df, fits, 1, "student_t").first()
    assert margin.tinf_err == pytest.approx(want[0] / 0.5 * 0.01 * 1.96, rel=0.1)


def test_saturating(spark):
    t = np.arange(0, 300.0)
    rows = [("r", i, float(a), "m", float(20 * (1 - 0.7 * np.exp(-a / 40)))) for i, a in enumerate(t)]
    row = fitting.fit_saturating(spark.createDataFrame(rows, "run_id string, seq long, t double, metric string, value double")).first()
    assert (row.a, row.b, row.c) == (pytest.approx(20, rel=1e-3), pytest.approx(0.7, rel=1e-3), pytest.approx(1 / 40, rel=1e-3))


def test_fits_meet_the_conditions_of_an_optimum(spark):
    """Noise without any exponential in it: fits end at bounds or in long valleys, and still are optima."""
    rng = np.random.default_rng(12)
    rows = [(f"r{r}", i, float(t), "temp", float(y)) for r in range(40)
            for i, (t, y) in enumerate(zip(np.sort(rng.uniform(0, 700, 14)), rng.uniform(0, 100, 14)))]
    df = spark.createDataFrame(rows, "run_id string, seq long, t double, metric string, value double")
    for order in (1, 2):
        fits = fitting.fit(df, order)
        assert fitting.certified(df, fits, order).where("optimal").count() == 40
        off = fits.withColumn("tinf", F.col("tinf") + F.when(F.col("tinf") > 60, -3.0).otherwise(3.0))
        assert fitting.certified(df, off, order).where("optimal").count() < 10


def test_bins_of_some_series():
    from runlens.functions.exponentials import Bins

    rng = np.random.default_rng(3)
    heads, n = np.array([0, 4, 9, 10]), 17
    bins = Bins(heads, np.sort(rng.uniform(0, 9, n)), rng.normal(size=(6, n)), rng.normal(size=(6, n)), rng.normal(size=n) ** 2)
    some = bins.some(np.array([1, 3]))
    for power in (0, 1, 2):
        np.testing.assert_allclose(some.sums(np.array([0.2, 0.4]), "y", power), bins.sums(np.array([9, 0.2, 9, 0.4]), "y", power)[[1, 3]])
    np.testing.assert_allclose(some.yy, bins.yy[[1, 3]])


def test_a_singular_step_of_one_series_does_not_stop_the_others():
    # Two points, both terms at the same bound of k and nothing left to fit: the matrix of the step is exactly singular.
    few = [339.02386638555555, 519.7068742916666], [1.77, 35.18]
    many = list(np.arange(40.0) * 9), list(50 - 20 * np.exp(-np.arange(40.0) * 9 / 30) - 10 * np.exp(-np.arange(40.0) * 9 / 200))
    t, y = (np.array(few[i] + many[i]) for i in (0, 1))
    centre = np.sinh((np.floor(np.arcsinh(t) * fitting.BINS_PER_FOLD) + 0.5) / fitting.BINS_PER_FOLD)
    powers = np.stack([(t - centre) ** i for i in range(fitting.MOMENTS)])
    bins = Bins(np.array([0, 2]), centre, powers, powers * y, y * y)
    boxes = [T_BOUNDS, *expand_bounds(K_BOUNDS, 2)]
    low, high = np.full((2, 2), 1.0), np.full((2, 2), 3600.0)
    with np.errstate(all="ignore"):
        taus, v, rss = refined(bins, *grid_best(bins, tau_tuples(2, TAU_BOUNDS), boxes), low, high, boxes)
    assert rss[0] == pytest.approx(0, abs=1e-9) and rss[1] == pytest.approx(0, abs=1e-6)
    assert sorted(taus[1]) == pytest.approx([30, 200], rel=1e-3)
