"""Queries over files: the given tables are written as files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import columns as cols
from ..operators import rows, tables
from ..operators.columns import split_units, strip_units
from ..plans.blocks import Scan
from ..plans.scratch import once, scratch_path, written
from ..sources import catalogs, fits, membench, runfiles, specs
from ..views import long_view, sensor_view, table
from .base import SENSOR, neighbours, query, rnd, sql_rnd
from .results import _HOURS, TAUS, _first_fit, _order_1

# (position, header, metric, factor to the header's unit)
HEADERS = [(1, "ambient/°C", "ambient", 1.0), (2, "cpu_0_temp/m°C", "cpu_0_temp", 1000.0), (3, "cpu_1_temp/mC", "cpu_1_temp", 1000.0),
           (4, "cam_cpu", "cam_cpu", 1.0), (5, "work_done", "work_done", 1.0), (6, 'note "x", text', 'note "x", text', None)]


def _file_rows(spark, d):
    """Samples in file units plus a text cell with quotes and commas on every camera row."""
    rows_ = sensor_view(spark, d)
    factor = F.create_map(*[F.lit(x) for _, _, m, f in HEADERS if f for x in (m, f)])
    numeric = rows_.select("run_id", "seq", "t", "metric", (F.col("value") * factor[F.col("metric")]).alias("value"), F.lit(None).cast("string").alias("text"))
    notes = rows_.where("metric = 'cam_cpu'").select("run_id", "seq", "t", F.lit(HEADERS[5][2]).alias("metric"), F.lit(None).cast("double").alias("value"),
                                                     F.concat(F.lit('say "'), F.col("seq").cast("string"), F.lit('", ok')).alias("text"))
    return numeric.unionByName(notes)


def _columns(run_ids):
    # Runs with an odd number lack the second temperature: every run has its own columns.
    heads = F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(h).alias("raw_name"), F.lit(m).alias("metric")) for p, h, m, _ in HEADERS])
    each = run_ids.select("run_id", F.inline(heads))
    return each.where((F.col("run_id") % 2 == 0) | (F.col("metric") != "cpu_1_temp"))


def _written_runs(spark, d):
    """The run files of a data folder, written once per session."""
    def make(path):
        samples = written(_file_rows(spark, d), "rows")
        starts = table(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.min("ts").alias("started_at"))
        runs = starts.select("run_id", F.date_trunc("second", "started_at").cast("timestamp_ntz").alias("started_at"), F.lit("+0000").alias("zone"),
                             F.concat(F.lit("v"), F.col("run_id").cast("string")).alias("version"), F.lit("bench -t 5, fast").alias("command"))
        # Odd runs have no second temperature: those cells are left out, their lines stay.
        runfiles.write_runs(samples, _columns(runs.select("run_id")), runs, path, drop_unlisted=True)

    return once(spark, f"runs of {d}", make)


def _read(spark, d, **options):
    return runfiles.read_runs(spark, _written_runs(spark, d), **options)


_KEPT = "NOT (metric = 'cpu_1_temp' AND run_id % 2 = 1)"


@query("read_runs", f"""WITH {SENSOR}
SELECT CAST(run_id AS VARCHAR) AS run_id, metric, {sql_rnd('t', 4)} AS t, {sql_rnd('value', 4)} AS value, NULL AS text FROM sen WHERE {_KEPT}
UNION ALL SELECT CAST(run_id AS VARCHAR), 'note "x", text', {sql_rnd('t', 4)}, NULL, concat('say "', seq, '", ok') FROM sen WHERE metric = 'cam_cpu'""")
def _(spark, d):
    s = _read(spark, d).samples
    return s.select("run_id", "metric", rnd("t", 4).alias("t"), rnd("value", 4).alias("value"), "text")


@query("read_runs_order", f"""WITH {SENSOR}
SELECT CAST(run_id AS VARCHAR) AS run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY seq) - 1 AS BIGINT) AS seq, {sql_rnd('t', 4)} AS t FROM sen""")
def _(spark, d):
    # Every line has a number; the odd runs' lines with only the missing column are blank and carry none.
    lines = runfiles._lines(spark, _written_runs(spark, d)).where(F.col("line").rlike("^[0-9.E-]+,"))
    numbered = Scan(lines, ["run_id"], ["id"], F.col("start")).total("seq", F.lit(1).cast("long")).result()
    return numbered.select("run_id", (F.col("seq") - 1).alias("seq"), rnd(F.expr("double(split(line, ',')[0]) / 1000"), 4).alias("t"))


@query("run_metadata", """SELECT CAST(user_id AS VARCHAR) AS run_id, strftime(date_trunc('second', min(ts)), '%Y-%m-%d %H:%M:%S') AS started,
'+0000' AS zone, concat('v', user_id) AS version, 'bench -t 5, fast' AS command, count(*) AS n_rows FROM events GROUP BY user_id""")
def _(spark, d):
    runs = _read(spark, d).runs
    return runs.select("run_id", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started"), "zone", "version", "command", "n_rows")


@query("run_names", """SELECT DISTINCT CAST(user_id AS VARCHAR) AS run_id, 'fan run' AS name, 'imx8' AS board, concat('v', user_id) AS version FROM events""")
def _(spark, d):
    runs = _read(spark, d, name="fan run", board="imx8").runs
    return runs.select("run_id", "name", F.col("meta")["board"].alias("board"), F.col("meta")["version"].alias("version"))


@query("run_columns", """WITH u AS (SELECT DISTINCT user_id FROM events), h AS (SELECT * FROM (VALUES ('time/ms', 'time', 'ms'), ('ambient/°C', 'ambient', '°C'),
('cpu_0_temp/m°C', 'cpu_0_temp', 'm°C'), ('cpu_1_temp/mC', 'cpu_1_temp', 'mC'), ('cam_cpu', 'cam_cpu', 'no unit'), ('work_done', 'work_done', 'no unit'),
('note "x", text', 'note "x", text', 'no unit')) h(raw_name, name, unit))
SELECT CAST(user_id AS VARCHAR) AS run_id, raw_name, name, unit FROM u CROSS JOIN h WHERE NOT (name = 'cpu_1_temp' AND user_id % 2 = 1)""")
def _(spark, d):
    return _read(spark, d).columns.select("run_id", "raw_name", "name", "unit")


@query("stored_runs", f"""WITH {SENSOR} SELECT CAST(run_id AS VARCHAR) AS run_id, count(*) AS n, {sql_rnd('sum(value)', 3)} AS total
FROM sen WHERE metric = 'cpu_0_temp' AND value > 20 GROUP BY 1""")
def _(spark, d):
    path = scratch_path(spark, "store")
    runfiles.save_runs(_read(spark, d), path)
    kept = runfiles.load_runs(spark, path).samples.where("metric = 'cpu_0_temp' and value > 20")
    return kept.groupBy("run_id").agg(F.count("*").alias("n"), rnd(F.sum("value"), 3).alias("total"))


@query("normalize_units", f"""WITH {SENSOR} SELECT CAST(run_id AS VARCHAR) AS run_id, metric, CASE WHEN metric IN ('ambient', 'cpu_0_temp', 'cpu_1_temp') THEN '°C' ELSE 'no unit' END AS unit,
count(*) AS n, {sql_rnd('sum(value)', 3)} AS total FROM sen WHERE {_KEPT} GROUP BY 1, 2, 3""")
def _(spark, d):
    raw = _read(spark, d, normalize=False).samples.where("value is not null")
    out = cols.normalize_units(raw)
    return out.groupBy("run_id", "metric", "unit").agg(F.count("*").alias("n"), rnd(F.sum("value"), 3).alias("total"))


_RAW = """raw AS (SELECT user_id AS run_id, event_type AS metric, value,
  CASE event_type WHEN 'view' THEN 'ms' WHEN 'click' THEN 'mC' WHEN 'purchase' THEN 'Instructions executed' WHEN 'signup' THEN 'V' ELSE 'kHz' END AS unit,
  CASE event_type WHEN 'view' THEN value * 20000 WHEN 'purchase' THEN value * 1000 ELSE value END AS v FROM events)"""


@query("normalize_report_units", f"""WITH {_RAW}, pk AS (SELECT run_id, metric, max(v) AS top FROM raw GROUP BY 1, 2),
nu AS (SELECT run_id, metric, CASE WHEN unit = 'ms' AND top > 7200000 THEN v / 3600000 WHEN unit = 'ms' AND top > 120000 THEN v / 60000 WHEN unit = 'ms' AND top > 2000 THEN v / 1000
  WHEN unit = 'mC' THEN v / 1000 WHEN unit = 'V' THEN v * 1000 WHEN unit = 'kHz' THEN v / 1000
  WHEN unit = 'Instructions executed' THEN v / power(10, length(CAST(CAST(floor(top) AS BIGINT) AS VARCHAR)) - 1) ELSE v END AS value,
  CASE WHEN unit = 'ms' AND top > 7200000 THEN 'hours' WHEN unit = 'ms' AND top > 120000 THEN 'minutes' WHEN unit = 'ms' AND top > 2000 THEN 'seconds' WHEN unit = 'mC' THEN '°C'
  WHEN unit = 'V' THEN 'mV' WHEN unit = 'kHz' THEN 'MHz' WHEN unit = 'Instructions executed' THEN concat('10^', length(CAST(CAST(floor(top) AS BIGINT) AS VARCHAR)) - 1, ' instructions executed')
  ELSE unit END AS unit FROM raw JOIN pk USING (run_id, metric))
SELECT run_id, metric, unit, count(*) AS n, {sql_rnd('sum(value)')} AS total FROM nu GROUP BY 1, 2, 3""")
def _(spark, d):
    metric = F.col("metric")
    unit = (F.when(metric == "view", F.lit("ms")).when(metric == "click", F.lit("mC")).when(metric == "purchase", F.lit("Instructions executed"))
            .when(metric == "signup", F.lit("V")).otherwise(F.lit("kHz")))
    value = F.when(metric == "view", F.col("value") * 20000).when(metric == "purchase", F.col("value") * 1000).otherwise(F.col("value"))
    raw = long_view(spark, d).select("run_id", "seq", "metric", unit.alias("unit"), value.alias("value"))
    return cols.normalize_report_units(raw).groupBy("run_id", "metric", "unit").agg(F.count("*").alias("n"), rnd(F.sum("value")).alias("total"))


_PARTS = "SELECT p_partkey, concat(p_name, CASE p_partkey % 5 WHEN 0 THEN '/m°C' WHEN 1 THEN '/Hz' WHEN 2 THEN '_ms' WHEN 3 THEN '_%' ELSE '' END) AS raw_name FROM part"


def _parts(spark, d):
    k = F.col("p_partkey") % 5
    tail = F.when(k == 0, F.lit("/m°C")).when(k == 1, F.lit("/Hz")).when(k == 2, F.lit("_ms")).when(k == 3, F.lit("_%")).otherwise(F.lit(""))
    return table(spark, d, "part").select("p_partkey", F.concat("p_name", tail).alias("raw_name"))


@query("split_units", f"WITH p AS ({_PARTS}) SELECT p_partkey, trim(split_part(raw_name, '/', 1)) AS name, coalesce(nullif(split_part(raw_name, '/', 2), ''), 'no unit') AS unit FROM p")
def _(spark, d):
    return split_units(_parts(spark, d)).select("p_partkey", "name", "unit")


@query("strip_units", f"WITH p AS ({_PARTS}) SELECT p_partkey, regexp_replace(raw_name, '_(ms|s|m°C|°C|Hz|%)$', '') AS name FROM p")
def _(spark, d):
    return strip_units(_parts(spark, d).withColumnRenamed("raw_name", "name")).select("p_partkey", "name")


@query("select_metrics", f"""WITH {SENSOR}, pt AS (SELECT * FROM (VALUES (0, 'temp'), (1, 'cpu')) p(match, pat))
SELECT run_id, metric, match, count(*) AS n FROM sen JOIN pt ON contains(metric, pat) GROUP BY 1, 2, 3""")
def _(spark, d):
    return cols.select_metrics(sensor_view(spark, d), contains=["temp", "cpu"]).groupBy("run_id", "metric", "match").agg(F.count("*").alias("n"))


@query("select_metrics_regex", f"WITH {SENSOR} SELECT run_id, metric, seq, value FROM sen WHERE regexp_matches(metric, '^cpu_[0-9]_temp$')")
def _(spark, d):
    return cols.select_metrics(sensor_view(spark, d), regex="^cpu_[0-9]_temp$").select("run_id", "metric", "seq", "value")


@query("filter_samples", f"WITH {SENSOR} SELECT run_id, metric, seq, value FROM sen WHERE value > 50 AND t < 1000000 AND contains(metric, 'temp')")
def _(spark, d):
    return sensor_view(spark, d).where("value > 50 and t < 1000000 and contains(metric, 'temp')").select("run_id", "metric", "seq", "value")


@query("scale", f"WITH {SENSOR} SELECT run_id, seq, {sql_rnd('t / 60')} AS t, {sql_rnd('value * 0.001')} AS value FROM sen")
def _(spark, d):
    return cols.scale(sensor_view(spark, d), 1 / 60, 1e-3).select("run_id", "seq", rnd("t").alias("t"), rnd("value").alias("value"))


@query("default_scale", """WITH u AS (SELECT DISTINCT user_id FROM events), h AS (SELECT * FROM (VALUES ('time/ms', 0.001), ('ambient/°C', 1.0), ('cpu_0_temp/m°C', 0.001),
('cpu_1_temp/mC', 0.001), ('cam_cpu', 1.0), ('work_done', 1.0), ('note "x", text', 1.0)) h(raw_name, scale))
SELECT CAST(user_id AS VARCHAR) AS run_id, raw_name, CAST(scale AS DOUBLE) AS scale, 'time/ms' AS x_column FROM u CROSS JOIN h WHERE NOT (raw_name = 'cpu_1_temp/mC' AND user_id % 2 = 1)""")
def _(spark, d):
    return cols.default_scale(_read(spark, d).columns).select("run_id", "raw_name", "scale", "x_column")


@query("prune_columns", f"WITH {SENSOR} SELECT run_id, metric, seq, {sql_rnd('value')} AS value FROM sen WHERE metric = 'cam_cpu' OR contains(metric, 'work')")
def _(spark, d):
    return cols.prune_columns(sensor_view(spark, d), ["cam_cpu"], ["work"]).select("run_id", "metric", "seq", rnd("value").alias("value"))


@query("validate_runs", """WITH u AS (SELECT DISTINCT user_id FROM events)
SELECT CAST(user_id AS VARCHAR) AS run_id, 'first column is not time' AS violation FROM u WHERE user_id % 10 = 3
UNION ALL SELECT CAST(user_id AS VARCHAR), 'fewer than two columns' FROM u WHERE user_id % 7 = 0
UNION ALL SELECT CAST(user_id AS VARCHAR), 'missing value in the first column' FROM (SELECT user_id FROM events WHERE event_id % 50 = 0 GROUP BY 1)""")
def _(spark, d):
    users = table(spark, d, "events").select(F.col("user_id").alias("u")).distinct()
    first = F.when(F.col("u") % 10 == 3, F.lit("speed")).otherwise(F.lit("time/ms"))
    heads = F.when(F.col("u") % 7 == 0, F.array(first)).otherwise(F.array(first, F.lit("a"), F.lit("b")))
    headers = users.select(F.col("u").cast("string").alias("run_id"), F.posexplode(heads).alias("pos", "raw_name"))
    cells = table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.when(F.col("event_id") % 50 != 0, F.col("value")).alias("t"))
    return rows.validate_runs(headers, cells)


@query("all_columns", """SELECT h.name, count(DISTINCT user_id) AS runs FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (VALUES ('time'), ('ambient'), ('cpu_0_temp'), ('cpu_1_temp'),
('cam_cpu'), ('work_done'), ('note "x", text')) h(name) WHERE NOT (h.name = 'cpu_1_temp' AND user_id % 2 = 1) GROUP BY 1""")
def _(spark, d):
    return cols.all_columns(_read(spark, d).columns)


@query("runs_with", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS run_id FROM events WHERE user_id % 2 = 0")
def _(spark, d):
    return cols.runs_with(_read(spark, d).columns, "cpu_1_temp")


@query("x_columns", """SELECT name, unit, count(DISTINCT user_id) AS runs FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (VALUES ('time', 'ms'), ('work_done', 'no unit')) h(name, unit) GROUP BY 1, 2""")
def _(spark, d):
    return cols.x_columns(_read(spark, d).columns, ["time", "work"])


_CATS = {"temp": "Temperature", "work": "Work", "ambient": "Ambient", "freq": "Frequency"}


def _lines_with_x(spark, d):
    """Sensor rows where every line also carries its number as a column."""
    rows_ = sensor_view(spark, d).select("run_id", "seq", "t", "metric", "value")
    return rows_.unionByName(rows_.withColumn("metric", F.lit("index")).withColumn("value", F.col("seq").cast("double")))


@query("category_table", f"""WITH {SENSOR}, c AS (SELECT * FROM (VALUES ('temp', 'Temperature'), ('work', 'Work'), ('ambient', 'Ambient'), ('freq', 'Frequency')) c(pat, category))
SELECT run_id, 'index' AS x, category, metric, seq, CAST(seq AS DOUBLE) AS x_value, {sql_rnd('value')} AS y_value FROM sen JOIN c ON contains(metric, pat)""")
def _(spark, d):
    return tables.category_table(_lines_with_x(spark, d), _CATS, "index").withColumn("y_value", rnd("y_value"))


@query("column_table", f"WITH {SENSOR} SELECT run_id, CAST(seq AS DOUBLE) AS x, {sql_rnd('value')} AS value FROM sen WHERE metric = 'cpu_0_temp'")
def _(spark, d):
    return tables.column_table(_lines_with_x(spark, d), "cpu_0_temp", "index").withColumn("value", rnd("value"))


@query("write_fits", f"WITH {_HOURS}, {_order_1('hrs', 'run_id, metric', TAUS)} SELECT run_id, metric, n, {sql_rnd('tinf', 4)} AS tinf, {sql_rnd('rmse', 4)} AS rmse FROM o1")
def _(spark, d):
    path = scratch_path(spark, "fits")
    fits.write_fits(_first_fit(spark, d).where("tinf is not null"), path)
    back = spark.read.schema("run_id long, metric string, n long, rss double, rmse double, tinf double, t_first double, t_last double").option("header", "true").csv(path)
    return back.select("run_id", "metric", "n", rnd("tinf", 4).alias("tinf"), rnd("rmse", 4).alias("rmse"))


@query("sensor_catalog", """WITH s AS (SELECT s_suppkey AS k, s_nationkey AS testbed FROM supplier)
SELECT testbed, CASE WHEN k % 3 = 0 THEN concat('zone', k) ELSE concat('S', k, '_temp') END AS name, CASE WHEN k % 3 = 2 THEN 'm°C' END AS unit, concat('/sys/zone', k, '/temp') AS path,
CASE WHEN k % 3 = 0 THEN concat('zone', k) WHEN k % 3 = 1 THEN concat('S', k, '_temp') ELSE concat('S', k, '_temp/m°C') END AS raw_name FROM s WHERE k % 7 <> 0 AND k % 5 <> 0""")
def _(spark, d):
    return catalogs.parse_sensor_lines(_sensor_lines(spark, d))[0].select("testbed", "name", "unit", "path", "raw_name")


def _sensor_lines(spark, d):
    k, key = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    path = F.concat(F.lit("/sys/zone"), key, F.lit("/temp"))
    line = (F.when(k % 7 == 0, F.concat(F.lit("# zone "), key))
            .when(k % 5 == 0, F.concat(F.lit("!(@a"), key, F.lit("=,b) ssh host"), key))
            .when(k % 3 == 0, path).when(k % 3 == 1, F.concat(path, F.lit("  S"), key, F.lit("_temp")))
            .otherwise(F.concat(path, F.lit("\tS"), key, F.lit("_temp  m°C"))))
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("testbed"), line.alias("line"))


@query("sensor_commands", """WITH s AS (SELECT s_suppkey AS k, s_nationkey AS testbed FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 5 = 0)
SELECT testbed, concat('ssh host', k) AS command, concat('a', k) AS "column", true AS sync, false AS catch_all FROM s
UNION ALL SELECT testbed, concat('ssh host', k), 'b', false, true FROM s""")
def _(spark, d):
    return catalogs.parse_sensor_lines(_sensor_lines(spark, d))[1]


# A line per order: the results of all its lines as threads, and their sum.
@query("read_membench", """WITH q AS (SELECT l_orderkey AS size, l_linenumber, sum(l_quantity) AS result FROM lineitem GROUP BY 1, 2)
SELECT size, CAST(row_number() OVER (PARTITION BY size ORDER BY l_linenumber) - 1 AS INTEGER) AS thread, result FROM q""")
def _(spark, d):
    items = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    results = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "q"))), lambda x: x["q"].cast("string"))
    lines = items.groupBy("l_orderkey").agg(results.alias("results"), F.sum("q").cast("string").alias("total"))
    line = F.concat_ws("\t", F.col("l_orderkey").cast("string"), "results", F.concat(F.lit("∑"), F.col("total")))
    path = scratch_path(spark, "mem")
    lines.select(line.alias("value")).write.text(path)
    return membench.read_membench(spark, path)[0].select("size", "thread", "result")


@query("membench_timings", "SELECT CAST(l_linenumber AS INTEGER) AS cpu, l_suppkey AS size, l_quantity AS time FROM lineitem")
def _(spark, d):
    line = F.concat(F.lit("CPU"), F.col("l_linenumber").cast("string"), F.lit(" size:"), F.col("l_suppkey").cast("string"), F.lit(" time:"), F.col("l_quantity").cast("string"))
    lines = table(spark, d, "lineitem").select(line.alias("line"))
    return membench.parse_membench(lines)[1].select("cpu", "size", "time")


def _spec_rows(spark, d):
    """A record per run: even runs plain, odd ones less ambient and smoothed."""
    users = table(spark, d, "events").select(F.col("user_id").alias("u")).distinct()
    odd = F.col("u") % 2 == 1
    return users.select(
        F.lit("Time").alias("x_axis_title"), F.lit("Temp").alias("y_axis_title"), F.concat(F.lit("Figure "), (F.col("u") % 5).cast("string")).alias("figure_title"),
        F.col("u").cast("int").alias("spec_no"), F.col("u").cast("string").alias("data_path"), F.lit("time").alias("x_col_name"), F.lit(1e-3).alias("x_scale"),
        F.lit("cpu_0_temp").alias("y_col_name"), F.lit(0.5).alias("y_scale"), F.lit("CPU").alias("y_label"), F.lit("#ff0000").alias("color"), F.lit("solid").alias("linestyle"),
        F.when(odd, F.lit("ambient")).alias("y_subtract"), F.lit(0.25).alias("y_subtract_scale"), F.when(odd, F.lit(4)).alias("smoothing_window_size"))


@query("specs_round_trip", "SELECT DISTINCT concat('Figure ', user_id % 5) AS figure_title, CAST(user_id AS VARCHAR) AS run, 0.5::DOUBLE AS y_scale, CASE WHEN user_id % 2 = 1 THEN 4.0::DOUBLE END AS width FROM events")
def _(spark, d):
    path = scratch_path(spark, "specs")
    specs.write_specs(_spec_rows(spark, d), path)
    back = specs.read_specs(spark, path)
    return back.select("figure_title", F.element_at(F.split("data_path", "/"), -1).alias("run"), "y_scale", F.col("smoothing_window_size").cast("double").alias("width"))


@query("apply_specs", f"""WITH {SENSOR}, {{nb}},
pl AS (SELECT run_id, seq, t * 0.001 AS x, value * 0.5 AS y, 'CPU' AS label FROM sen WHERE metric = 'cpu_0_temp' AND run_id % 2 = 0),
mi AS (SELECT run_id, seq, t * 0.001 AS x, coalesce(cpu_0_temp, cpu_0_temp_pv, cpu_0_temp_nv) * 0.5 - coalesce(ambient, ambient_pv, ambient_nv) * 0.25 AS y FROM itp WHERE run_id % 2 = 1),
sm AS (SELECT run_id, seq, x, avg(y) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS y, 'CPU' AS label FROM mi WHERE y IS NOT NULL)
SELECT CAST(run_id AS VARCHAR) AS run_id, seq, {sql_rnd('x')} AS x, {sql_rnd('y')} AS y, label FROM (SELECT * FROM pl UNION ALL SELECT * FROM sm)""".replace(
    "{nb}", neighbours(["ambient", "cpu_0_temp"])))
def _(spark, d):
    samples = sensor_view(spark, d).withColumn("run_id", F.col("run_id").cast("string"))
    out = specs.apply_specs(samples, _spec_rows(spark, d))
    return out.select("run_id", "seq", rnd("x").alias("x"), rnd("y").alias("y"), "label")
