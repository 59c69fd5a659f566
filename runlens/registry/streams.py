"""Queries over output lines and over the streaming forms of the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.lines import pack_rows, parse_lines
from ..plans.scratch import scratch_path
from ..sources import runfiles, tail
from ..streaming import sinks, stateful, windows
from ..views import counter_view, line_view, table
from .base import LONG, ORACLES, SENSOR, query, rnd, sql_rnd
from .files import _written_runs
from .ordered import _COUNTERS

DAY = 86400
SPECS = ["view=", "@click=", "other"]
_LINES = f"""{LONG}, ln AS (SELECT run_id, seq, CASE WHEN metric = 'signup' THEN concat('note ', event_id) ELSE concat(metric, '=', value) END AS line FROM lng)"""


@query("parse_lines", f"""WITH {_LINES}
SELECT run_id, seq, CASE WHEN starts_with(line, 'view=') THEN 'view' WHEN starts_with(line, 'click=') THEN 'click' ELSE 'other' END AS metric,
       CASE WHEN starts_with(line, 'view=') OR starts_with(line, 'click=') THEN substring(line, strpos(line, '=') + 1) ELSE line END AS text,
       starts_with(line, 'click=') AS sync, NOT (starts_with(line, 'view=') OR starts_with(line, 'click=')) AS catch_all FROM ln""")
def _(spark, d):
    return parse_lines(line_view(spark, d), SPECS).drop("t")


@query("parse_lines_stream", f"""WITH ln AS (SELECT user_id AS run_id, event_id, concat(event_type, '=', value) AS line FROM events)
SELECT run_id, event_id, split_part(line, '=', 1) AS metric, split_part(line, '=', 2) AS text FROM ln WHERE starts_with(line, 'view=') OR starts_with(line, 'click=')""")
def _(spark, d):
    lines = event_stream(spark, d).select("run_id", "event_id", F.concat("metric", F.lit("="), F.col("value").cast("string")).alias("line"))
    return sinks.drain(parse_lines(lines, ["view=", "click="]), "lines").select("run_id", "event_id", "metric", "text")


@query("pack_rows", f"""WITH RECURSIVE {LONG}, ev AS (
  SELECT run_id, seq // 8 AS batch, seq, CASE WHEN metric IN ('view', 'click', 'error') THEN metric ELSE 'stdout' END AS metric,
         CASE WHEN metric IN ('view', 'click', 'error') THEN CAST(value AS VARCHAR) WHEN metric = 'signup' THEN concat('note ', event_id) ELSE concat(metric, '=', value) END AS text
  FROM lng),
st AS (
  SELECT run_id, batch, seq, metric, text, 0 AS row_no, [metric] AS seen FROM ev WHERE seq % 8 = 0
  UNION ALL
  SELECT e.run_id, e.batch, e.seq, e.metric, e.text,
         CASE WHEN s.metric = 'stdout' OR (e.metric <> 'stdout' AND list_contains(s.seen, e.metric)) THEN s.row_no + 1 ELSE s.row_no END,
         CASE WHEN s.metric = 'stdout' OR (e.metric <> 'stdout' AND list_contains(s.seen, e.metric)) THEN [e.metric] ELSE list_append(s.seen, e.metric) END
  FROM st s JOIN ev e ON e.run_id = s.run_id AND e.batch = s.batch AND e.seq = s.seq + 1)
SELECT run_id, batch, row_no, metric, text FROM st""")
def _(spark, d):
    events = parse_lines(line_view(spark, d), ["view=", "click=", "error="], stdout="stdout")
    packed = pack_rows(events.withColumn("batch", F.floor(F.col("seq") / 8)), ["run_id", "batch"])
    return packed.select("run_id", "batch", "row_no", F.explode("cells").alias("metric", "text"))


# A run of single-key batches packs to one row per value.
@query("pack_rows_single", f"""WITH {LONG}, v AS (SELECT run_id, seq // 8 AS batch, seq, value FROM lng WHERE metric = 'view')
SELECT run_id, batch, CAST(row_number() OVER (PARTITION BY run_id, batch ORDER BY seq) - 1 AS INTEGER) AS row_no, CAST(value AS VARCHAR) AS view FROM v""")
def _(spark, d):
    events = parse_lines(line_view(spark, d), ["view="])
    packed = pack_rows(events.withColumn("batch", F.floor(F.col("seq") / 8)), ["run_id", "batch"])
    return packed.select("run_id", "batch", "row_no", F.col("cells")["view"].alias("view"))


BATCHES = 3
TRIGGERS = 20


def event_stream(spark, d):
    """The events table as a file stream of ``BATCHES`` batches, in time order."""
    events, path = table(spark, d, "events"), scratch_path(spark, "events")
    cuts = [F.lit(0)] + [events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), i / BATCHES)).first()[0] for i in range(1, BATCHES)]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    for i, low in enumerate(cuts):
        part = events.where(at >= low) if i + 1 == BATCHES else events.where((at >= low) & (at < cuts[i + 1]))
        part.write.mode("append").parquet(f"{path}/part={i}")
    raw = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", max(1, events.rdd.getNumPartitions())).parquet(f"{path}/*")
    return raw.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("metric"), "ts", "event_id", "value")


def static_events(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("metric"), "ts", "event_id", "value")


_TICKS = "SELECT user_id AS run_id, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS tick, event_type AS metric, arg_max(value, ts) AS value FROM events GROUP BY 1, 2, 3"


@query("sync_sample_windows", _TICKS)
def _(spark, d):
    return windows.sync_sample_stream(static_events(spark, d), DAY)


# Append mode keeps back the windows that the watermark, two periods behind, has not passed.
@query("sync_sample_stream", f"SELECT * FROM ({_TICKS}) WHERE tick <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)")
def _(spark, d):
    ticks = sinks.drain(windows.sync_sample_stream(event_stream(spark, d), DAY), "ticks")
    return ticks.withColumn("tick", F.col("tick").cast("timestamp_ntz"))


@query("latest", "SELECT event_type AS metric, arg_max(value, ts) AS value, max(ts) AS ts, count(*) AS readings FROM events GROUP BY 1")
def _(spark, d):
    return windows.latest(static_events(spark, d), ["metric"])


@query("latest_stream", "SELECT event_type AS metric, arg_max(value, ts) AS value, max(ts) AS ts, count(*) AS readings FROM events GROUP BY 1")
def _(spark, d):
    return sinks.drain(windows.latest(event_stream(spark, d), ["metric"]), "latest", "complete")


@query("sample_per_period", """SELECT user_id AS run_id, time_bucket(INTERVAL 1 DAY, ts) AS period, event_type AS metric, arg_min(value, CAST(concat('0x', substring(md5(CAST(event_id AS VARCHAR)), 1, 15)) AS BIGINT)) AS value
FROM events GROUP BY 1, 2, 3""")
def _(spark, d):
    return windows.sample_per_period(static_events(spark, d), DAY)


def _timed_stream(spark, d):
    seconds = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) / F.lit(1e6)
    return event_stream(spark, d).select("run_id", "metric", seconds.alias("t"), "value")


_SECONDS = "sec AS (SELECT user_id AS run_id, event_type AS metric, event_id, ts, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 AS t, value FROM events)"


@query("low_pass_stream", f"""WITH {_SECONDS},
num AS (SELECT *, row_number() OVER w - 1 AS pos, first_value(value) OVER w AS y0 FROM sec WINDOW w AS (PARTITION BY run_id, metric ORDER BY ts, event_id))
SELECT x.run_id, x.metric, {sql_rnd('x.t')} AS t, {sql_rnd('max(x.y0) * power(333.0 / 343.0, max(x.pos) + 1) + sum(10.0 / 343.0 * power(333.0 / 343.0, x.pos - y.pos) * y.value)')} AS filtered
FROM num x JOIN num y ON x.run_id = y.run_id AND x.metric = y.metric AND y.pos <= x.pos GROUP BY x.run_id, x.metric, x.t""")
def _(spark, d):
    out = sinks.drain(stateful.low_pass_stream(_timed_stream(spark, d), 10, 333), "lowpass")
    return out.select("run_id", "metric", rnd("t").alias("t"), rnd("filtered").alias("filtered"))


@query("energy_stream", f"""WITH {_SECONDS}, st AS (SELECT run_id, metric, t, ts, event_id, coalesce(value * 1e-6 * (t - lag(t) OVER w), 0) AS step FROM sec WINDOW w AS (PARTITION BY run_id, metric ORDER BY ts, event_id))
SELECT run_id, metric, {sql_rnd('t')} AS t, {sql_rnd('sum(step) OVER (PARTITION BY run_id, metric ORDER BY ts, event_id)')} AS energy FROM st""")
def _(spark, d):
    out = sinks.drain(stateful.energy_stream(_timed_stream(spark, d)), "energy")
    return out.select("run_id", "metric", rnd("t").alias("t"), rnd("energy").alias("energy"))


@query("cpu_load_stream", f"""WITH {_COUNTERS}
SELECT run_id, {sql_rnd('t')} AS t, {sql_rnd('coalesce(act / nullif(act + idle, 0) * 100, 0)')} AS load FROM dlt WHERE act IS NOT NULL""")
def _(spark, d):
    path = scratch_path(spark, "counters")
    counters = counter_view(spark, d)
    counters.write.parquet(path)
    out = sinks.drain(stateful.cpu_load_stream(spark.readStream.schema(counters.schema).parquet(path)), "load")
    return out.select("run_id", rnd("t").alias("t"), rnd("load").alias("load"))


@query("throttled_stream", f"""WITH RECURSIVE {_SECONDS}, e AS (
  SELECT run_id, metric, min(t) AS mark, min(t) AS last FROM sec GROUP BY 1, 2
  UNION ALL
  SELECT run_id, metric, mark + {DAY} AS mark, nt AS last FROM (
    SELECT e.run_id, e.metric, e.mark, (SELECT min(s.t) FROM sec s WHERE s.run_id = e.run_id AND s.metric = e.metric AND s.t > e.last AND s.t > e.mark + {DAY}) AS nt FROM e) x
  WHERE nt IS NOT NULL),
f AS (SELECT *, min(mark) OVER (PARTITION BY run_id, metric) AS first FROM e)
SELECT f.run_id, f.metric, {sql_rnd('f.last')} AS t, s.value FROM f JOIN sec s ON s.run_id = f.run_id AND s.metric = f.metric AND s.t = f.last WHERE f.mark > f.first""")
def _(spark, d):
    out = sinks.drain(stateful.throttled(_timed_stream(spark, d), DAY), "throttled").where("t is not null")
    return out.select("run_id", "metric", rnd("t").alias("t"), "value")


@query("read_runs_stream", f"""WITH {SENSOR}, s AS (SELECT metric, value FROM sen WHERE NOT (metric = 'cpu_1_temp' AND run_id % 2 = 1)
UNION ALL SELECT 'note "x", text', NULL FROM sen WHERE metric = 'cam_cpu')
SELECT metric, count(*) AS n, {sql_rnd("sum(CASE WHEN metric IN ('cpu_0_temp', 'cpu_1_temp') THEN value * 1000 ELSE value END)", 2)} AS total FROM s GROUP BY 1""")
def _(spark, d):
    # Triggers of 20 files; of more where that would be more than TRIGGERS, since every trigger looks through all files.
    runs = table(spark, d, "events").select("user_id").distinct().count()
    path = _written_runs(spark, d)
    with runfiles.few_listings(spark):
        rows = sinks.drain(runfiles.read_runs_stream(spark, path, max_files=max(20, runs // TRIGGERS)), "rows")
    return rows.groupBy("metric").agg(F.count("*").alias("n"), rnd(F.sum("value"), 2).alias("total"))


# The same rows as the batch reader's, from files followed in several triggers.
@query("follow_runs", ORACLES["read_runs"])
def _(spark, d):
    path = _written_runs(spark, d)
    third = runfiles.stored_bytes(spark, path) // 3
    out = scratch_path(spark, "followed")
    query_ = (tail.follow_runs(spark, path, max_bytes=third + 1).writeStream.format("parquet")
              .option("checkpointLocation", scratch_path(spark, "followed-state")).start(out))
    try:
        query_.processAllAvailable()
    finally:
        query_.stop()
    return spark.read.parquet(out).select("run_id", "metric", rnd("t", 4).alias("t"), rnd("value", 4).alias("value"), "text")


@query("write_runs_stream", f"""SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS metric, count(*) AS n, {sql_rnd('sum(value)', 3)} AS total FROM events GROUP BY 1, 2""")
def _(spark, d):
    stream = _timed_stream(spark, d).withColumn("text", F.lit(None).cast("string"))
    users = table(spark, d, "events").select(F.col("user_id").alias("run_id")).distinct()
    names = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(m).alias("raw_name"), F.lit(m).alias("metric"))
                      for i, m in enumerate(["click", "error", "purchase", "signup", "view"], 1)])
    columns = users.select("run_id", F.inline(names))
    runs = users.select("run_id", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("started_at"), F.lit("+0000").alias("zone"),
                        F.lit("1").alias("version"), F.lit("bench").alias("command"))
    path = scratch_path(spark, "appended")
    sinks.write_runs_stream(stream, columns, runs, path, scratch_path(spark, "appended-state")).awaitTermination()
    back = runfiles.read_runs(spark, path).samples
    return back.groupBy("run_id", "metric").agg(F.count("*").alias("n"), rnd(F.sum("value"), 3).alias("total"))
