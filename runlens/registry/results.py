"""Queries over aggregates, fits and the tables built from them.

Fits count time in hours here, since the given event times span a month.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import t_quantile
from ..functions.model import model_expr
from ..functions.text import common_prefix, common_suffix
from ..operators import aggregates, columns, fitting, joins, tables
from ..plans.blocks import meet
from ..plans.grids import expand_bounds
from ..plans.scratch import written
from ..views import long_view, memory_view, sensor_view, table
from .base import LONG, SENSOR, query, rnd, sql_rnd

TAUS = [48.0, 80.0, 120.0, 200.0, 320.0, 500.0]
PAIRS = [50.0, 120.0, 300.0]
INF = float("inf")
FREE = {"k_bounds": [(-INF, INF)], "t_bounds": (-INF, INF)}
TEMPS = ["cpu_0_temp", "cpu_1_temp"]
T_TABLE = "tq AS (SELECT * FROM (VALUES " + ", ".join(f"({d}, {t_quantile(d)!r})" for d in range(1, 400)) + ") q(dof, crit))"


def hours(spark, d):
    return columns.scale(long_view(spark, d), x=1 / 3600)


def sensor_hours(spark, d):
    return columns.scale(sensor_view(spark, d), x=1 / 3600)


_SPEED = SENSOR + """,
spd AS (
  SELECT run_id, metric, seq, (value - lag(value) OVER w) / nullif(t - lag(t) OVER w, 0) * 3600 AS ops
  FROM sen WHERE metric = 'work_done' WINDOW w AS (PARTITION BY run_id, metric ORDER BY seq)),
est AS (SELECT run_id, avg(ops) AS val, count(ops) AS n, stddev_samp(ops) AS sd FROM spd WHERE ops IS NOT NULL GROUP BY 1),
ops AS (SELECT run_id, val AS ops, CASE WHEN n = 1 THEN CAST('Infinity' AS DOUBLE) ELSE sd * crit END AS ops_err FROM est LEFT JOIN tq ON tq.dof = n - 1)"""


@query("mean_est", f"""WITH {T_TABLE}, {LONG}, a AS (SELECT run_id, metric, avg(value) AS val, stddev_samp(value) AS sd, count(*) AS n FROM lng GROUP BY 1, 2)
SELECT run_id, metric, n, {sql_rnd('val')} AS val, CASE WHEN n = 1 THEN CAST('Infinity' AS DOUBLE) ELSE {sql_rnd('sd * crit')} END AS err FROM a LEFT JOIN tq ON dof = n - 1""")
def _(spark, d):
    est = aggregates.mean_estimate(long_view(spark, d), ["run_id", "metric"], "value")
    return est.select("run_id", "metric", "n", rnd("val").alias("val"), rnd("err").alias("err"))


@query("ops_est", f"WITH {T_TABLE}, {_SPEED} SELECT run_id, {sql_rnd('ops', 5)} AS ops, {sql_rnd('ops_err', 5)} AS ops_err FROM ops")
def _(spark, d):
    est = aggregates.ops_est(sensor_hours(spark, d), drop_inf=True)
    return est.select("run_id", rnd("ops", 5).alias("ops"), rnd("ops_err", 5).alias("ops_err"))


@query("mean_speed", f"WITH {T_TABLE}, {_SPEED} SELECT run_id, metric, {sql_rnd('avg(ops)', 5)} AS speed FROM spd WHERE ops IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return aggregates.mean_speed(sensor_hours(spark, d), drop_inf=True).select("run_id", "metric", rnd("speed", 5).alias("speed"))


@query("describe", f"""WITH v AS (SELECT 'value' AS variable, value AS v FROM events UNION ALL SELECT 'user', CAST(user_id AS DOUBLE) FROM events)
SELECT variable, count(v) AS n, count(*) - count(v) AS missing, {sql_rnd('avg(v)')} AS mean, {sql_rnd('stddev_samp(v)')} AS std,
       min(v) AS min, max(v) AS max, {sql_rnd('quantile_cont(v, 0.25)')} AS q25, {sql_rnd('quantile_cont(v, 0.5)')} AS median,
       {sql_rnd('quantile_cont(v, 0.75)')} AS q75 FROM v GROUP BY 1""")
def _(spark, d):
    df = table(spark, d, "events").select("value", F.col("user_id").alias("user"))
    out = aggregates.describe(df, ["value", "user"])
    return out.select("variable", "n", "missing", "min", "max", *[rnd(c).alias(c) for c in ("mean", "std", "q25", "median", "q75")])


@query("quantiles", f"""SELECT event_type, {sql_rnd('quantile_cont(value, 0.1)')} AS q0, {sql_rnd('quantile_cont(value, 0.75)')} AS q1
FROM events GROUP BY 1""")
def _(spark, d):
    q = aggregates.quantiles(table(spark, d, "events"), "value", [0.1, 0.75], ["event_type"])
    return q.select("event_type", rnd("q0").alias("q0"), rnd("q1").alias("q1"))


@query("histogram", f"""WITH m AS (SELECT min(value) AS a, max(value) AS b, (max(value) - min(value)) / 30 AS w FROM events),
c AS (SELECT least(floor((value - a) / w), 29) AS bin, count(*) AS n FROM events CROSS JOIN m GROUP BY 1)
SELECT CAST(g.bin AS INTEGER) AS bin, {sql_rnd('a + g.bin * w')} AS low, coalesce(n, 0) AS n FROM range(0, 30) g(bin) CROSS JOIN m LEFT JOIN c ON c.bin = g.bin""")
def _(spark, d):
    return aggregates.histogram(table(spark, d, "events"), "value", 30).select("bin", rnd("low").alias("low"), "n")


@query("histogram_not_finite", f"""WITH v AS (SELECT CASE event_id % 50 WHEN 0 THEN 'inf'::DOUBLE WHEN 1 THEN '-inf'::DOUBLE WHEN 2 THEN 'nan'::DOUBLE ELSE value END AS v FROM events),
m AS (SELECT min(v) AS a, max(v) AS b, (max(v) - min(v)) / 30 AS w FROM v WHERE isfinite(v)),
c AS (SELECT CASE WHEN isfinite(v) THEN least(floor((v - a) / w), 29) WHEN isnan(v) THEN NULL WHEN v > 0 THEN 30 ELSE -1 END AS bin, count(*) AS n FROM v CROSS JOIN m GROUP BY 1)
SELECT CAST(g.bin AS INTEGER) AS bin, {sql_rnd('a + g.bin * w')} AS low, coalesce(n, 0) AS n FROM range(0, 30) g(bin) CROSS JOIN m LEFT JOIN c ON c.bin = g.bin
UNION ALL SELECT CAST(coalesce(bin, -2) AS INTEGER), NULL, n FROM c WHERE bin IS NULL OR bin NOT BETWEEN 0 AND 29""")
def _(spark, d):
    left = F.col("event_id") % 50
    odd = F.when(left == 0, float("inf")).when(left == 1, float("-inf")).when(left == 2, float("nan")).otherwise(F.col("value"))
    bins = aggregates.histogram(table(spark, d, "events").withColumn("value", odd), "value", 30)
    return bins.select(F.coalesce("bin", F.lit(-2)).alias("bin"), F.when(F.col("bin").between(0, 29), rnd("low")).alias("low"), "n")


@query("coverage", f"""WITH {SENSOR}, h AS (SELECT DISTINCT run_id, metric FROM sen)
SELECT 'ambient' AS x, a.run_id, CASE WHEN bool_or(contains(h.metric, 'temp')) THEN 'yes' ELSE 'N/A' END AS "Temperature",
       CASE WHEN bool_or(contains(h.metric, 'cam')) THEN 'yes' ELSE 'N/A' END AS "Camera",
       CASE WHEN bool_or(contains(h.metric, 'freq')) THEN 'yes' ELSE 'N/A' END AS "Frequency"
FROM h a JOIN h ON a.run_id = h.run_id WHERE a.metric = 'ambient' GROUP BY 2""")
def _(spark, d):
    return aggregates.coverage(sensor_view(spark, d), {"temp": "Temperature", "cam": "Camera", "freq": "Frequency"}, ["ambient"])


@query("coverage_time", f"""WITH {SENSOR}, h AS (SELECT DISTINCT run_id, metric FROM sen)
SELECT 'time' AS x, run_id, CASE WHEN bool_or(contains(metric, 'temp')) THEN 'yes' ELSE 'N/A' END AS "Temperature",
       CASE WHEN bool_or(contains(metric, 'freq')) THEN 'yes' ELSE 'N/A' END AS "Frequency" FROM h GROUP BY 2""")
def _(spark, d):
    return aggregates.coverage(sensor_view(spark, d), {"temp": "Temperature", "freq": "Frequency"}, ["time"])


@query("memory_bandwidth", f"""SELECT l_suppkey AS size, count(*) AS threads, {sql_rnd('sum(64 / (l_extendedprice / l_quantity) * 1e9 / 1048576)', 3)} AS bandwidth,
{sql_rnd('avg(l_extendedprice / l_quantity)', 4)} AS latency FROM lineitem GROUP BY 1""")
def _(spark, d):
    out = aggregates.memory_bandwidth(memory_view(spark, d), "M")
    return out.select("size", "threads", rnd("bandwidth", 3).alias("bandwidth"), rnd("latency", 4).alias("latency"))


# --- fits -------------------------------------------------------------------

_HOURS = LONG + ", hrs AS (SELECT run_id, metric, seq, t / 3600 AS t, value AS y FROM lng)"


def _order_1(source: str, keys: str, taus: list[float]) -> str:
    """Order-1 search over given taus without coefficient bounds."""
    return f"""g AS (SELECT unnest([{', '.join(map(str, taus))}]) AS tau),
q AS (SELECT {keys}, tau, regr_slope(y, exp(-t / tau)) AS k, regr_intercept(y, exp(-t / tau)) AS tinf,
             regr_syy(y, exp(-t / tau)) - power(regr_sxy(y, exp(-t / tau)), 2) / nullif(regr_sxx(y, exp(-t / tau)), 0) AS rss, count(*) AS n
      FROM {source} CROSS JOIN g GROUP BY {keys}, tau HAVING count(*) > 3),
o1 AS (SELECT *, sqrt(rss / (n - 3)) AS rmse FROM q QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY round(rss, 9), tau) = 1)"""


def _fit_columns(fits, keys=("run_id", "metric"), order=1):
    cells = [rnd("tinf", 4).alias("tinf"), rnd("rmse", 4).alias("rmse")]
    for i in range(order):
        cells += [rnd(F.col("terms")[i]["k"], 4).alias(f"k{i + 1}"), rnd(F.col("terms")[i]["tau"], 4).alias(f"tau{i + 1}")]
    return fits.select(*keys, "n", *cells)


# Series with too few rows for a fit stay, without results.
_ALL = "(SELECT {keys}, count(*) AS n FROM {source} GROUP BY {keys}) LEFT JOIN (SELECT * EXCLUDE (n) FROM o1) USING ({keys})"
_FIT_1 = f"SELECT {{keys}}, n, {sql_rnd('tinf', 4)} AS tinf, {sql_rnd('rmse', 4)} AS rmse, {sql_rnd('k', 4)} AS k1, {sql_rnd('tau', 4)} AS tau1 FROM {_ALL}"


@query("fit_order_1", f"WITH {_HOURS}, {_order_1('hrs', 'run_id, metric', TAUS)} {_FIT_1.format(keys='run_id, metric', source='hrs')}")
def _(spark, d):
    return _fit_columns(fitting.fit(hours(spark, d), 1, rounds=0, taus=TAUS, **FREE))


# The best of the nine faces of the (T, k) box, spelled out.
_BOXED = f"""WITH {_HOURS}, g AS (SELECT unnest([{', '.join(map(str, TAUS))}]) AS tau),
s AS (SELECT run_id, metric, tau, count(*) AS n, sum(exp(-t / tau)) AS se, sum(exp(-2 * t / tau)) AS see, sum(y) AS sy,
             sum(y * exp(-t / tau)) AS sey, sum(y * y) AS syy FROM hrs CROSS JOIN g GROUP BY 1, 2, 3 HAVING count(*) > 3),
c AS (
  SELECT *, (n * sey - se * sy) / (n * see - se * se) AS k, (sy - (n * sey - se * sy) / (n * see - se * se) * se) / n AS tinf FROM s
  UNION ALL SELECT s.*, p AS k, (sy - p * se) / n FROM s CROSS JOIN (VALUES (-120.0), (120.0)) v(p)
  UNION ALL SELECT s.*, (sey - p * se) / see AS k, p FROM s CROSS JOIN (VALUES (0.0), (120.0)) v(p)
  UNION ALL SELECT s.*, p AS k, r FROM s CROSS JOIN (VALUES (-120.0), (120.0)) v(p) CROSS JOIN (VALUES (0.0), (120.0)) w(r)),
f AS (SELECT *, greatest(syy - 2 * (tinf * sy + k * sey) + n * tinf * tinf + 2 * tinf * k * se + k * k * see, 0) AS rss
      FROM c WHERE k BETWEEN -120.0000001 AND 120.0000001 AND tinf BETWEEN -0.0000001 AND 120.0000001),
o1 AS (SELECT *, sqrt(rss / (n - 3)) AS rmse FROM f QUALIFY row_number() OVER (PARTITION BY run_id, metric ORDER BY round(rss, 9), tau) = 1)
"""


@query("fit_order_1_boxed", _BOXED + _FIT_1.format(keys="run_id, metric", source="hrs"))
def _(spark, d):
    return _fit_columns(fitting.fit(hours(spark, d), 1, rounds=0, taus=TAUS))


@query("fit_order_2", f"""WITH {_HOURS}, g AS (SELECT a.x AS t1, b.x AS t2 FROM (VALUES {', '.join(f'({x})' for x in PAIRS)}) a(x)
  JOIN (VALUES {', '.join(f'({x})' for x in PAIRS)}) b(x) ON a.x < b.x),
m AS (SELECT run_id, metric, t1, t2, count(*) AS n, avg(y) AS my, avg(exp(-t / t1)) AS m1, avg(exp(-t / t2)) AS m2,
        var_pop(exp(-t / t1)) AS c11, var_pop(exp(-t / t2)) AS c22, covar_pop(exp(-t / t1), exp(-t / t2)) AS c12,
        covar_pop(exp(-t / t1), y) AS c1y, covar_pop(exp(-t / t2), y) AS c2y, var_pop(y) AS cyy
      FROM hrs CROSS JOIN g GROUP BY 1, 2, 3, 4 HAVING count(*) > 5),
k AS (SELECT *, (c1y * c22 - c2y * c12) / (c11 * c22 - c12 * c12) AS k1, (c2y * c11 - c1y * c12) / (c11 * c22 - c12 * c12) AS k2 FROM m
      WHERE c11 * c22 - c12 * c12 > 0),
r AS (SELECT *, n * (cyy - k1 * c1y - k2 * c2y) AS rss, my - k1 * m1 - k2 * m2 AS tinf FROM k),
b AS (SELECT *, sqrt(greatest(rss, 0) / (n - 5)) AS rmse FROM r QUALIFY row_number() OVER (PARTITION BY run_id, metric ORDER BY round(rss, 6), t1, t2) = 1),
e AS (SELECT run_id, metric, count(*) AS n, arg_min(t, seq) AS ta, arg_max(t, seq) AS tb FROM hrs GROUP BY 1, 2)
SELECT run_id, metric, e.n, {sql_rnd('rmse', 4)} AS rmse, {sql_rnd('tinf + k1 * exp(-ta / t1) + k2 * exp(-ta / t2)', 4)} AS start,
       {sql_rnd('tinf + k1 * exp(-tb / t1) + k2 * exp(-tb / t2)', 4)} AS finish FROM e LEFT JOIN b USING (run_id, metric)""")
def _(spark, d):
    fits = fitting.fit(hours(spark, d), 2, rounds=0, taus=PAIRS, **FREE)
    at = lambda t: rnd(model_expr(F.col(t), F.col("tinf"), F.col("terms")), 4)
    return fits.select("run_id", "metric", "n", rnd("rmse", 4).alias("rmse"), at("t_first").alias("start"), at("t_last").alias("finish"))


# The optimum itself has no closed form; the conditions it has to meet have: every series with enough rows meets them.
@query("fit_zoomed", f"""WITH {SENSOR}
SELECT run_id, metric, count(*) AS n, count(*) > 5 AS optimal FROM sen WHERE metric IN ('cpu_0_temp', 'cpu_1_temp') GROUP BY 1, 2""")
def _(spark, d):
    series = written(sensor_hours(spark, d).where(F.col("metric").isin(TEMPS)), "series")
    return fitting.certified(series, fitting.fit(series, 2), 2).select("run_id", "metric", "n", F.coalesce("optimal", F.lit(False)).alias("optimal"))


@query("fit_quick", f"""WITH {_HOURS}, sh AS (SELECT run_id, metric, t - first_value(t) OVER (PARTITION BY run_id, metric ORDER BY seq) AS t, y FROM hrs),
{_order_1('sh', 'run_id, metric', TAUS)} {_FIT_1.format(keys='run_id, metric', source='sh')}""")
def _(spark, d):
    return _fit_columns(fitting.fit_quick(hours(spark, d), 1, rounds=0, taus=TAUS, **FREE))


@query("fit_saturating", f"""WITH {_HOURS}, {_order_1('hrs', 'run_id, metric', TAUS)}
SELECT run_id, metric, n, {sql_rnd('rmse', 4)} AS rmse, {sql_rnd('tinf', 4)} AS a, {sql_rnd('-k', 4)} AS ab, {sql_rnd('1 / tau')} AS c
FROM {_ALL.format(keys='run_id, metric', source='hrs')}""")
def _(spark, d):
    fits = fitting.fit_saturating(hours(spark, d), rounds=0, taus=TAUS)
    return fits.select("run_id", "metric", "n", rnd("rmse", 4).alias("rmse"), rnd("a", 4).alias("a"), rnd(F.col("a") * F.col("b"), 4).alias("ab"), rnd("c").alias("c"))


@query("fit_sweep", f"""WITH {_HOURS}, hz AS (SELECT run_id, metric, horizon, t, y FROM hrs JOIN (VALUES (240.0), (480.0), (720.0)) h(horizon) ON t < horizon),
{_order_1('hz', 'run_id, metric, horizon', TAUS[:4])} SELECT run_id, metric, CAST(horizon AS DOUBLE) AS horizon, n, {sql_rnd('rmse', 4)} AS rmse,
{sql_rnd('tinf + k * exp(-horizon / tau)', 2)} AS finish, {sql_rnd('tau', 4)} AS tau1 FROM {_ALL.format(keys='run_id, metric, horizon', source='hz')}""")
def _(spark, d):
    fits = fitting.fit_sweep(hours(spark, d), [240, 480, 720], 1, rounds=0, taus=TAUS[:4], **FREE)
    finish = model_expr(F.col("horizon"), F.col("tinf"), F.col("terms"))
    return fits.select("run_id", "metric", "horizon", "n", rnd("rmse", 4).alias("rmse"), rnd(finish, 2).alias("finish"), rnd(F.col("terms")[0]["tau"], 4).alias("tau1"))


# Every tau stays within a twentieth of the first fit's, and no residual sum rises.
@query("refit_around", f"""WITH {SENSOR}
SELECT run_id, metric, count(*) AS n, count(*) > 3 AS near, count(*) > 3 AS better FROM sen WHERE metric = 'cpu_0_temp' GROUP BY 1, 2""")
def _(spark, d):
    series = written(sensor_hours(spark, d).where("metric = 'cpu_0_temp'"), "series")
    first = written(fitting.fit(series, 1, rounds=0, taus=TAUS), "first")
    again = fitting.refit_around(series, first, 1, 0.05)
    both = meet(again, first.select("run_id", "metric", F.col("terms").alias("was"), F.col("rss").alias("rss0")), ["run_id", "metric"])
    ratio = F.col("terms")[0]["tau"] / F.col("was")[0]["tau"]
    near, better = ratio.between(0.95 - 1e-9, 1.05 + 1e-9), F.col("rss") <= F.col("rss0") * (1 + 1e-9) + 1e-9
    return both.select("run_id", "metric", "n", F.coalesce(near, F.lit(False)).alias("near"), F.coalesce(better, F.lit(False)).alias("better"))


@query("initial_guess", f"""WITH {LONG}, e AS (SELECT run_id, metric, arg_min(value, seq) AS a, arg_max(value, seq) AS b FROM lng GROUP BY 1, 2)
SELECT run_id, metric, greatest(least(b, 120), 0) AS tinf, {sql_rnd('greatest(least((a - b) / 2, 120), -120)')} AS k1,
{sql_rnd('greatest(least((a - b) / 2, 120), -120)')} AS k2, 20.5 AS tau1, 1800.5 AS tau2 FROM e""")
def _(spark, d):
    out = fitting.initial_guess(long_view(spark, d), 2, tau_bounds=[(1, 40), (1, 3600)])
    return out.select("run_id", "metric", "tinf", rnd("k1").alias("k1"), rnd("k2").alias("k2"), "tau1", "tau2")


@query("expand_bounds", """WITH g AS (SELECT unnest([1, 2, 3]) AS term, unnest([10.0, 60.0, 60.0]) AS lo, unnest([60.0, 1800.0, 1800.0]) AS hi)
SELECT term, lo, hi, count(*) FILTER (WHERE value BETWEEN lo AND hi) AS inside FROM events CROSS JOIN g GROUP BY 1, 2, 3""")
def _(spark, d):
    boxes = expand_bounds([(10, 60), (60, 1800)], 3)
    cells = F.array(*[F.struct(F.lit(i).alias("term"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for i, (lo, hi) in enumerate(boxes, 1)])
    tried = table(spark, d, "events").select("value", F.inline(cells))
    return tried.groupBy("term", "lo", "hi").agg(F.count_if(F.col("value").between(F.col("lo"), F.col("hi"))).alias("inside"))


def _first_fit(spark, d):
    return fitting.fit(hours(spark, d), 1, rounds=0, taus=TAUS, **FREE)


@query("model_values", f"""WITH {_HOURS}, {_order_1('hrs', 'run_id, metric', TAUS)}
SELECT run_id, metric, seq, {sql_rnd('tinf + k * exp(-t / tau)', 4)} AS model, {sql_rnd('y - (tinf + k * exp(-t / tau))', 4)} AS residual
FROM hrs JOIN o1 USING (run_id, metric)""")
def _(spark, d):
    res = fitting.residuals(hours(spark, d), _first_fit(spark, d))
    return res.select("run_id", "metric", "seq", rnd("model", 4).alias("model"), rnd("residual", 4).alias("residual"))


@query("normal_sums", f"""WITH {_HOURS}, {_order_1('hrs', 'run_id, metric', TAUS)},
j AS (SELECT run_id, metric, exp(-t / tau) AS e, k * t * exp(-t / tau) / (tau * tau) AS f, y - (tinf + k * exp(-t / tau)) AS r FROM hrs JOIN o1 USING (run_id, metric))
SELECT run_id, metric, count(*) AS n, {sql_rnd('sum(e)')} AS j01, {sql_rnd('sum(f)', 4)} AS j02, {sql_rnd('sum(e * e)')} AS j11, {sql_rnd('sum(e * f)', 4)} AS j12,
       {sql_rnd('sum(r * r)', 3)} AS rss FROM j GROUP BY 1, 2""")
def _(spark, d):
    s = fitting.normal_sums(hours(spark, d), _first_fit(spark, d), 1)
    return s.select("run_id", "metric", "n", rnd("jj_0_1").alias("j01"), rnd("jj_0_2", 4).alias("j02"), rnd("jj_1_1").alias("j11"),
                    rnd("jj_1_2", 4).alias("j12"), rnd("rss", 3).alias("rss"))


# Diagonal of the inverse of the 3x3 normal matrix, by cofactors.
@query("parameter_errors", f"""WITH {_HOURS}, {_order_1('hrs', 'run_id, metric', TAUS)},
j AS (SELECT run_id, metric, exp(-t / tau) AS e, k * t * exp(-t / tau) / (tau * tau) AS f FROM hrs JOIN o1 USING (run_id, metric)),
s AS (SELECT run_id, metric, count(*) AS a, sum(e) AS b, sum(f) AS c, sum(e * e) AS d, sum(e * f) AS g, sum(f * f) AS h FROM j GROUP BY 1, 2),
i AS (SELECT *, a * (d * h - g * g) - b * (b * h - g * c) + c * (b * g - d * c) AS det FROM s),
r AS (SELECT run_id, metric, 0.5 * sqrt((d * h - g * g) / det) AS tinf_err, 0.5 * sqrt((a * h - c * c) / det) AS k_err, 0.5 * sqrt((a * d - b * b) / det) AS tau_err
      FROM i WHERE det > 1e-6 * a * d * h),
u AS (SELECT run_id, metric FROM hrs GROUP BY 1, 2)
SELECT run_id, metric, CASE WHEN tinf_err < 20 THEN {sql_rnd('tinf_err', 4)} END AS tinf_err, CASE WHEN k_err < 20 THEN {sql_rnd('k_err', 4)} END AS k_err
FROM u LEFT JOIN r USING (run_id, metric)""")
def _(spark, d):
    series = hours(spark, d)
    fits = fitting.fit(series, 1, rounds=0, taus=TAUS, **FREE)
    sums = fitting.normal_sums(series, fits, 1)
    # As in the twin, large errors and those from a nearly singular normal matrix are compared as unknown.
    det = F.expr("jj_0_0 * (jj_1_1 * jj_2_2 - jj_1_2 * jj_1_2) - jj_0_1 * (jj_0_1 * jj_2_2 - jj_1_2 * jj_0_2) + jj_0_2 * (jj_0_1 * jj_1_2 - jj_1_1 * jj_0_2)")
    regular = sums.where(det > 1e-6 * F.expr("jj_0_0 * jj_1_1 * jj_2_2")).select("run_id", "metric", F.lit(True).alias("regular"))
    errs = fitting.parameter_errors(series, fits, 1).join(regular, ["run_id", "metric"], "left")
    shown = lambda c: F.when(F.col("regular") & (c < 20), rnd(c, 4))
    return errs.select("run_id", "metric", shown(F.col("tinf_err")).alias("tinf_err"), shown(F.col("terms")[0]["k_err"]).alias("k_err"))


@query("fit_text", f"""WITH {_HOURS}, {_order_1('hrs', 'run_id, metric', TAUS)}
SELECT run_id, metric, concat(printf('%.1f', tinf), CASE WHEN k < 0 THEN ' – ' ELSE ' + ' END, printf('%.1f', abs(k)), '⋅e^{{−t/', printf('%.1f', tau), '}}') AS text FROM o1""")
def _(spark, d):
    return fitting.legend(_first_fit(spark, d)).where("tinf is not null").select("run_id", "metric", "text")


@query("fit_curves", f"""WITH {_HOURS}, {_order_1('hrs', 'run_id, metric', TAUS)},
x AS (SELECT run_id, metric, arg_min(t, seq) AS a, arg_max(t, seq) AS b FROM hrs GROUP BY 1, 2), sp AS (SELECT min(a) AS a, max(b) AS b FROM x)
SELECT run_id, metric, i, {sql_rnd('a + (b - a) * i / 499', 4)} AS t, CASE WHEN abs(tinf + k * exp(-(a + (b - a) * i / 499) / tau)) < 500 THEN {sql_rnd('tinf + k * exp(-(a + (b - a) * i / 499) / tau)', 2)} END AS value
FROM o1 CROSS JOIN sp CROSS JOIN (SELECT CAST(range AS INTEGER) AS i FROM range(0, 500))""")
def _(spark, d):
    # Curves of short series far outside their time range are compared by their presence.
    value = F.when(F.abs("value") < 500, rnd("value", 2))
    return fitting.fit_curves(_first_fit(spark, d)).select("run_id", "metric", "i", rnd("t", 4).alias("t"), value.alias("value"))


@query("fit_components", f"""WITH {_HOURS}, {_order_1('hrs', 'run_id, metric', TAUS)},
x AS (SELECT run_id, metric, arg_min(t, seq) AS a, arg_max(t, seq) AS b FROM hrs GROUP BY 1, 2)
SELECT run_id, metric, 0 AS term_no, tau, i, {sql_rnd('tinf + k * exp(-(a + (b - a) * i / 49) / tau)', 3)} AS value
FROM o1 JOIN x USING (run_id, metric) CROSS JOIN (SELECT CAST(range AS INTEGER) AS i FROM range(0, 50))""")
def _(spark, d):
    return fitting.fit_components(_first_fit(spark, d), 50).select("run_id", "metric", "term_no", "tau", "i", rnd("value", 3).alias("value"))


_RUNS = "SELECT DISTINCT run_id, concat('run-', run_id, '.csv') AS name FROM lng"
_SEN_HOURS = "sh AS (SELECT run_id, metric, seq, t / 3600 AS t, value AS y FROM sen WHERE metric IN ('cpu_0_temp', 'cpu_1_temp'))"


def _runs(samples):
    return samples.select("run_id").distinct().withColumn("name", F.concat(F.lit("run-"), F.col("run_id").cast("string"), F.lit(".csv")))


def _multi(spark, d, metrics=TEMPS, **options):
    samples = sensor_hours(spark, d)
    return fitting.multi_fit(samples, list(metrics), _runs(samples), 1, rounds=0, taus=TAUS, drop_inf=True, **{**FREE, **options})


_MULTI = f"{T_TABLE}, {_SPEED}, {_SEN_HOURS}, {_order_1('sh', 'run_id, metric', TAUS)}, mf AS (SELECT concat('run-', run_id, '.csv') AS name, * FROM {_ALL.format(keys='run_id, metric', source='sh')} LEFT JOIN ops USING (run_id))"


@query("multi_fit", f"""WITH {_MULTI} SELECT name, metric, n, {sql_rnd('rmse', 4)} AS rmse, {sql_rnd('ops', 4)} AS ops, {sql_rnd('tinf', 4)} AS tinf,
{sql_rnd('k', 4)} AS k1, {sql_rnd('tau', 4)} AS tau1, 'run-' AS title FROM mf""")
def _(spark, d):
    out = _multi(spark, d)
    return out.select("name", "metric", "n", *[rnd(c, 4).alias(c) for c in ("rmse", "ops", "tinf", "k1", "tau1")], "title")


_MINUS = f"""{_SEN_HOURS.replace("WHERE metric IN ('cpu_0_temp', 'cpu_1_temp')", "WHERE metric IN ('cpu_0_temp', 'ambient')")},
nb AS (SELECT *, last_value(CASE WHEN metric = 'ambient' THEN y END IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN metric = 'ambient' THEN t END IGNORE NULLS) OVER p AS pt,
  first_value(CASE WHEN metric = 'ambient' THEN y END IGNORE NULLS) OVER q AS nv, first_value(CASE WHEN metric = 'ambient' THEN t END IGNORE NULLS) OVER q AS nt
  FROM sh WINDOW p AS (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY run_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
mi AS (SELECT run_id, metric, t, y - (pv + (nv - pv) * (t - pt) / (nt - pt)) AS y FROM nb WHERE metric = 'cpu_0_temp' AND pv IS NOT NULL AND nv IS NOT NULL)"""


@query("multi_fit_subtract", f"""WITH {SENSOR}, {_MINUS}, {_order_1('mi', 'run_id, metric', TAUS)}
SELECT concat('run-', run_id, '.csv') AS name, metric, n, {sql_rnd('rmse', 3)} AS rmse, {sql_rnd('tinf', 3)} AS tinf, {sql_rnd('tau', 3)} AS tau1 FROM {_ALL.format(keys='run_id, metric', source='mi')}""")
def _(spark, d):
    out = _multi(spark, d, ["cpu_0_temp"], subtract="ambient")
    return out.select("name", "metric", "n", *[rnd(c, 3).alias(c) for c in ("rmse", "tinf", "tau1")])


@query("flag_bad", f"""WITH {_HOURS}, {_order_1('hrs', 'run_id, metric', TAUS)}, q3 AS (SELECT quantile_cont(rmse, 0.75) AS q FROM o1)
SELECT run_id, metric, {sql_rnd('rmse', 4)} AS rmse, rmse > 2 * q AS bad FROM o1 CROSS JOIN q3""")
def _(spark, d):
    fits = aggregates.flag_bad(_first_fit(spark, d).where("tinf is not null"))
    return fits.select("run_id", "metric", rnd("rmse", 4).alias("rmse"), "bad")


@query("repeatability", f"""WITH {_HOURS}, {_order_1('hrs', 'run_id, metric', TAUS)}
SELECT metric AS variant, count(tinf) AS n, {sql_rnd('avg(tinf)', 3)} AS mean, {sql_rnd('stddev_samp(tinf)', 3)} AS std FROM o1 GROUP BY 1""")
def _(spark, d):
    fits = _first_fit(spark, d).withColumn("variant", F.col("metric"))
    return aggregates.repeatability(fits).select("variant", "n", rnd("mean", 3).alias("mean"), rnd("std", 3).alias("std"))


@query("perf_per_temp", f"""WITH {_MULTI} SELECT name, metric, CASE WHEN abs(tinf) > 1 THEN {sql_rnd('ops / tinf', 4)} END AS perf,
CASE WHEN abs(tinf) > 1 THEN {sql_rnd('abs(ops / tinf) * sqrt(power(ops_err / ops, 2))', 4)} END AS perf_err FROM mf""")
def _(spark, d):
    # A ratio to a temperature near zero is compared by its presence.
    fits = _multi(spark, d)
    out = aggregates.perf_per_temp(fits.withColumn("tinf", F.when(F.abs("tinf") > 1, F.col("tinf"))))
    return out.select("name", "metric", rnd("perf", 4).alias("perf"), rnd("perf_err", 4).alias("perf_err"))


@query("tinf_and_ops", f"""WITH {_MULTI} SELECT name, metric, {sql_rnd('tinf', 4)} AS tinf, {sql_rnd('ops', 4)} AS performance FROM mf""")
def _(spark, d):
    out = aggregates.tinf_and_ops(_multi(spark, d))
    return out.select("name", "metric", rnd("tinf", 4).alias("tinf"), rnd("performance", 4).alias("performance"))


def _halves(spark, d):
    """Two result sets over the same runs, one per sensor."""
    fits = written(_multi(spark, d).drop("terms"), "fits")
    return [fits.where(F.col("metric") == m) for m in TEMPS]


_PAIRED = f"""WITH {_MULTI}, p AS (SELECT name, max(CASE WHEN metric = 'cpu_0_temp' THEN tinf END) AS a, max(CASE WHEN metric = 'cpu_1_temp' THEN tinf END) AS b
FROM mf GROUP BY 1)"""


@query("compare_tinf", f"{_PAIRED} SELECT name, {sql_rnd('a', 4)} AS tinf_1, {sql_rnd('b', 4)} AS tinf_2 FROM p")
def _(spark, d):
    return joins.compare_tinf(*_halves(spark, d), on=["name"]).select("name", rnd("tinf_1", 4).alias("tinf_1"), rnd("tinf_2", 4).alias("tinf_2"))


@query("tinf_bars", f"{_PAIRED} SELECT name AS label, {sql_rnd('a', 4)} AS cpu_0, {sql_rnd('b', 4)} AS cpu_1 FROM p")
def _(spark, d):
    return tables.tinf_bars(*_halves(spark, d), on=["name"], labels=["cpu_0", "cpu_1"]).select("label", rnd("cpu_0", 4).alias("cpu_0"), rnd("cpu_1", 4).alias("cpu_1"))


@query("tinf_ops_bars", f"WITH {_MULTI} SELECT name AS label, {sql_rnd('tinf', 4)} AS tinf, {sql_rnd('ops', 4)} AS ops, {sql_rnd('ops_err', 4)} AS ops_err FROM mf")
def _(spark, d):
    out = tables.tinf_ops_bars(_multi(spark, d))
    return out.select("label", rnd("tinf", 4).alias("tinf"), rnd("ops", 4).alias("ops"), rnd("ops_err", 4).alias("ops_err"))


@query("bar_table", "SELECT CAST(p_partkey AS VARCHAR) AS label, p_retailprice AS price, CAST(p_size AS DOUBLE) AS size, p_retailprice / 10 AS price_err FROM part")
def _(spark, d):
    parts = table(spark, d, "part").withColumn("e", F.col("p_retailprice") / 10)
    renamed = parts.select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"), "e")
    return aggregates.bar_table(renamed, "p_partkey", ["price", "size"], {"price": "e"}).drop("size_err")


# --- names and figures ------------------------------------------------------


@query("common_prefix", """WITH n AS (SELECT n_regionkey, n_name FROM nation),
p AS (SELECT n_regionkey, min(n_name) AS a, max(n_name) AS b, min(reverse(n_name)) AS c, max(reverse(n_name)) AS d FROM n GROUP BY 1)
SELECT n_regionkey, left(a, CAST(list_max([i FOR i IN range(0, least(length(a), length(b)) + 1) IF left(a, i) = left(b, i)]) AS INTEGER)) AS prefix,
       reverse(left(c, CAST(list_max([i FOR i IN range(0, least(length(c), length(d)) + 1) IF left(c, i) = left(d, i)]) AS INTEGER))) AS suffix FROM p""")
def _(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(
        common_prefix(F.col("n_name")).alias("prefix"), common_suffix(F.col("n_name")).alias("suffix"))


@query("series_titles", f"""WITH {_HOURS}, {_order_1('hrs', 'run_id, metric', TAUS)} SELECT run_id, metric, concat('run-', run_id, ', ', metric, row_number() OVER (ORDER BY run_id, metric)) AS title FROM o1""")
def _(spark, d):
    fits = _first_fit(spark, d).where("tinf is not null").withColumn("name", F.concat(F.lit("run-"), F.col("run_id").cast("string")))
    return columns.series_titles(fits, ["run_id", "metric"]).select("run_id", "metric", "title")


@query("series_table", f"""WITH {SENSOR} SELECT run_id, metric, seq, {sql_rnd('t / 60')} AS t, value FROM sen WHERE metric IN ('cpu_0_temp', 'cam_cpu')""")
def _(spark, d):
    return tables.series_table(sensor_view(spark, d), ["cpu_0_temp", "cam_cpu"], minutes=True).withColumn("t", rnd("t"))


@query("ambient_table", f"WITH {SENSOR} SELECT run_id, metric, seq, {sql_rnd('t / 60')} AS t, value FROM sen WHERE metric = 'ambient'")
def _(spark, d):
    return tables.series_table(sensor_view(spark, d), ["ambient"], minutes=True).withColumn("t", rnd("t"))


def _figure(spark, d):
    samples = hours(spark, d)
    fits = _first_fit(spark, d).where("tinf is not null").withColumn("name", F.concat(F.lit("run-"), F.col("run_id").cast("string")))
    return tables.fit_tables(fits, samples, pt_decim=3, n=50)


@query("fit_figure_points", f"""WITH {_HOURS}, num AS (SELECT *, row_number() OVER (PARTITION BY run_id, metric ORDER BY seq) - 1 AS pos FROM hrs)
SELECT run_id, metric, seq, {sql_rnd('t / 60')} AS t, y AS value FROM num WHERE pos % 3 = 0""")
def _(spark, d):
    return _figure(spark, d)[0].withColumn("t", rnd("t"))


@query("fit_figure_curves", f"""WITH {_HOURS}, {_order_1('hrs', 'run_id, metric', TAUS)},
x AS (SELECT run_id, metric, arg_min(t, seq) AS a, arg_max(t, seq) AS b, count(*) AS n FROM hrs GROUP BY 1, 2 HAVING count(*) > 3), sp AS (SELECT min(a) AS a, max(b) AS b FROM x)
SELECT run_id, metric, i, {sql_rnd('tinf + k * exp(-(a + (b - a) * i / 49) / tau)', 3)} AS value
FROM o1 CROSS JOIN sp CROSS JOIN (SELECT CAST(range AS INTEGER) AS i FROM range(0, 50))""")
def _(spark, d):
    return _figure(spark, d)[1].select("run_id", "metric", "i", rnd("value", 3).alias("value"))


@query("fit_figure_legend", f"""WITH {_HOURS}, {_order_1('hrs', 'run_id, metric', TAUS)}, q3 AS (SELECT quantile_cont(rmse, 0.75) AS q FROM o1)
SELECT run_id, metric, concat('run-', run_id, ', ', metric, row_number() OVER (ORDER BY concat('run-', run_id), metric)) AS title, rmse > 2 * q AS bad,
       concat(printf('%.1f', tinf), CASE WHEN k < 0 THEN ' – ' ELSE ' + ' END, printf('%.1f', abs(k)), '⋅e^{{−t/', printf('%.1f', tau / 60), '}}') AS text,
       concat('(±', printf('%.2g', rmse), CASE WHEN rmse > 2 * q THEN ' !!!' ELSE '' END, ')') AS note FROM o1 CROSS JOIN q3""")
def _(spark, d):
    return _figure(spark, d)[2].select("run_id", "metric", "title", "bad", "text", "note")


@query("category_table_time", f"""WITH {SENSOR}
SELECT run_id, 'time' AS x, c.title AS category, metric, seq, {sql_rnd('t')} AS x_value, {sql_rnd('value')} AS y_value
FROM sen JOIN (VALUES ('temp', 'Temperature'), ('cam', 'Camera')) c(pat, title) ON contains(metric, pat) WHERE value IS NOT NULL""")
def _(spark, d):
    out = tables.category_table(sensor_view(spark, d), {"temp": "Temperature", "cam": "Camera"}, "time")
    return out.withColumns({"x_value": rnd("x_value"), "y_value": rnd("y_value")})


@query("column_table_time", f"""WITH {SENSOR} SELECT run_id, {sql_rnd('t')} AS x, {sql_rnd('arg_max(value, seq)')} AS y FROM sen WHERE metric = 'cpu_0_temp' AND value IS NOT NULL GROUP BY run_id, t""")
def _(spark, d):
    out = tables.column_table(sensor_view(spark, d), "cpu_0_temp", "time")
    return out.select("run_id", rnd("x").alias("x"), rnd("value").alias("y"))


@query("sort_results", f"""WITH {_MULTI} SELECT name, metric, {sql_rnd('ops', 4)} AS ops FROM mf ORDER BY ops NULLS FIRST, name, metric""")
def _(spark, d):
    return (_multi(spark, d).select("name", "metric", rnd("ops", 4).alias("ops"))
            .orderBy("ops", "name", "metric"))
