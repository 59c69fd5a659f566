"""Joins between series, runs, ticks and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.blocks import BLOCK_ROWS, Scan, attach, last_seq, meet, number_rows
from ..plans.scratch import written
from .windows import interpolate_wide, long, wide

#: Runs that one aggregate turns into columns.
PIVOT_WIDTH = 500


def subtract(samples: DataFrame, metrics: list[str], sub: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each metric minus the interpolated ``sub``; rows where either is unknown drop out."""
    used = list(dict.fromkeys([*metrics, sub]))
    table = wide(samples.where(F.col("metric").isin(used)), used, block_rows).withColumn("_sub", F.col(sub))
    filled = interpolate_wide(table, ["_sub"], block_rows=block_rows)
    minus = filled.select("run_id", "seq", "t", *[(F.col(m) - F.col("_sub")).alias(m) for m in metrics])
    return long(minus, metrics).where(F.col("value").isNotNull())


def subtract_clamped(samples: DataFrame, y: str, sub: str, x_scale: float = 1.0, y_scale: float = 1.0,
                     sub_scale: float = 1.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Both columns interpolated at every row of the run with held edges, scaled and subtracted."""
    table = wide(samples, [y, sub], block_rows)
    filled = interpolate_wide(table, [y, sub], True, block_rows)
    value = F.col(y) * y_scale - F.col(sub) * sub_scale
    return (filled.select("run_id", "seq", (F.col("t") * x_scale).alias("t"), F.lit(y).alias("metric"), value.alias("value"))
            .where(F.col("value").isNotNull()))


def with_axis(samples: DataFrame, x: str, metric: str) -> DataFrame:
    """(run, seq, x, value) of one metric against another column of the same line, or against ``t``."""
    y = samples.where((F.col("metric") == metric) & F.col("value").isNotNull())
    if x == "t":
        return y.select("run_id", "seq", F.col("t").alias("x"), "value")
    axis = samples.where((F.col("metric") == x) & F.col("value").isNotNull()).select("run_id", "seq", F.col("value").alias("x"))
    return meet(y.select("run_id", "seq", "value"), axis, ["run_id", "seq"]).select("run_id", "seq", "x", "value")


def align_runs(samples: DataFrame, x: str, metric: str, runs: list | None = None) -> DataFrame:
    """One column over many runs keyed by x, the last value per (run, x), in long rows; with ``runs`` as by ``align_runs_wide``."""
    if runs is not None:
        return align_runs_wide(samples, x, metric, runs)
    return with_axis(samples, x, metric).groupBy("run_id", "x").agg(F.max_by("value", "seq").alias("value"))


def align_runs_wide(samples: DataFrame, x: str, metric: str, runs: list | None = None, width: int = PIVOT_WIDTH, packed: bool = False) -> DataFrame:
    """The full outer join of one column of all runs: a row per x, a column ``run_<id>`` per run.

    The runs are those that have the column, or those given; rows without x drop out.  The names of the result's columns are known to the
    planner, so their list is the one thing the driver holds.  The values are aggregated in long rows
    once and stored; then every ``width`` runs are turned into columns by one aggregate, and these blocks of
    columns are put side by side.

    A planner takes some thousands of columns at most.  With ``packed`` a row of the wide table comes as rows (x, block, runs, values), each with
    the columns of ``width`` runs in two arrays, NULL where a run has no value: for any number of runs.
    """
    points = align_runs(samples, x, metric).where(F.col("x").isNotNull())
    if packed:
        points = written(points, "aligned")
        return _packed(points, points.select("run_id").distinct() if runs is None
                       else points.sparkSession.createDataFrame([(r,) for r in dict.fromkeys(runs)], points.select("run_id").schema), width)
    points = written(points if runs is None else points.where(F.col("run_id").isin(runs)), "aligned")
    if runs is None:
        runs = [r[0] for r in points.select("run_id").distinct().orderBy("run_id").collect()]
    table = points.select("x").distinct()
    for start in range(0, len(runs), width):
        part = runs[start:start + width]
        block = points.groupBy("x").pivot("run_id", [r for r in part if r is not None]).agg(F.first("value"))
        block = block.toDF("x", *[f"run_{r}" for r in part if r is not None])
        if None in part:
            unnamed = points.where("run_id IS NULL").select("x", F.col("value").alias("run_null"))
            block = block.join(unnamed, "x", "left")
        table = table.join(block, "x", "left")
    return table


def _packed(points: DataFrame, runs: DataFrame, width: int) -> DataFrame:
    """The rows of the wide table in blocks of ``width`` columns."""
    numbered = number_rows(runs.withColumn("_all", F.lit(0)), ["_all"], ["run_id"], "at")
    placed = written(numbered.select("run_id", F.floor(F.col("at") / width).alias("block"), (F.col("at") % width).cast("int").alias("at")), "placed")
    heads = placed.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "run_id"))).alias("heads"))
    cells = meet(points, placed, ["run_id"]).groupBy("x", "block").agg(F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("cells"))
    table = points.select("x").distinct().crossJoin(heads).join(cells, ["x", "block"], "left")
    return table.select("x", "block", F.transform("heads", lambda h: h["run_id"]).alias("runs"),
                        F.transform("heads", lambda h: F.try_element_at("cells", h["at"])).alias("values"))


def sync_sample(events: DataFrame, ticks: DataFrame, keys: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Last value of each key since the previous tick, NULL if none came.

    ``events(run_id, seq, t, metric, value)``, ``ticks(run_id, t)``.  Rows after
    the last tick belong to none.
    """
    used = events.where(F.col("metric").isin(keys)).select(
        "run_id", "t", F.lit(0).alias("kind"), "seq", "metric", "value")
    marks = ticks.select("run_id", "t", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("seq"),
                         F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value"))
    both = number_rows(used.unionByName(marks), ["run_id"], ["t", "kind", "seq"], "_at")
    counted = Scan(both, ["run_id"], ["_at"], block_rows=block_rows).total("_ticks", F.col("kind").cast("long")).result()
    slot = F.col("_ticks") - F.col("kind")
    cells = [F.max_by("value", F.when(F.col("metric") == k, F.col("_at"))).alias(k) for k in keys]
    return (counted.groupBy("run_id", slot.alias("tick"))
            .agg(F.max(F.when(F.col("kind") == 1, F.col("t"))).alias("t"), *cells)
            .where(F.col("t").isNotNull()))


def calibrate(samples: DataFrame, y: str = "cpu_0_temp", x: str = "cam_cpu", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Least-squares line y = slope*x + intercept per run on rows where both are known after interpolation."""
    filled = interpolate_wide(wide(samples, [y, x], block_rows), [y, x], block_rows=block_rows)
    both = filled.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    return both.groupBy("run_id").agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.count("*").alias("n"))


def thermocam_correct(samples: DataFrame, y: str = "cpu_0_temp", x: str = "cam_cpu", prefix: str = "cam_",
                      block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Camera metrics mapped by the run's calibration line, the others unchanged, as are those of a run without a line."""
    line = calibrate(samples, y, x, block_rows).drop("n")
    sized = meet(samples.groupBy("run_id").agg(last_seq()), line, ["run_id"], "left")
    joined = attach(samples, sized, ["run_id"], block_rows=block_rows)
    line_value = F.col("value") * F.col("slope") + F.col("intercept")
    fixed = F.when(F.col("metric").startswith(prefix), F.coalesce(line_value, F.col("value"))).otherwise(F.col("value"))
    return joined.withColumn("value", fixed).drop("slope", "intercept")


def compare_tinf(*results: DataFrame, on: list[str] = ("name", "metric"), labels: list[str] | None = None) -> DataFrame:
    """T_inf of several result sets side by side, one row per ``on`` that any set has; a set without it has NULL.

    All sets must have the same ``subtract``: a set that differs fails the query when it runs.
    """
    labels = labels or [f"tinf_{i + 1}" for i in range(len(results))]
    on = list(on)
    out = None
    for label, fits in zip(labels, results):
        part = fits.select(*on, F.col("tinf").alias(label), F.col("subtract").alias("_next"))
        if out is None:
            out = part.withColumnRenamed("_next", "_subtract")
            continue
        out = out.join(part, on, "full")
        differs = F.col("_subtract") != F.col("_next")
        same = F.when(differs, F.raise_error(F.lit("result sets differ in subtract"))).otherwise(F.coalesce("_subtract", "_next"))
        out = out.withColumn("_subtract", same).drop("_next")
    # Filtered on, so that the comparison is not pruned away.
    return out.where("_subtract is null or _subtract or not _subtract").drop("_subtract")


def sweep_runs(runs: DataFrame, grid: DataFrame, pattern: str) -> DataFrame:
    """Grid points with the runs named after them; ``pattern`` captures the grid columns in order."""
    keyed = runs
    keys = grid.columns
    for i, key in enumerate(keys, 1):
        keyed = keyed.withColumn(key, F.expr(f"try_cast(regexp_extract(name, '{pattern}', {i}) as long)"))
    return grid.join(keyed.where(F.col(keys[0]).isNotNull()), keys, "left")


def power_grid(spark, low: tuple[int, int], high: tuple[int, int], condition, names=("global_ws", "local_ws")) -> DataFrame:
    """Pairs of powers of two, exponents low[0]..low[1] and high[0]..high[1], that satisfy ``condition``."""
    first = spark.range(low[0], low[1] + 1).select(F.expr("shiftleft(1L, cast(id as int))").alias(names[0]))
    second = F.explode(F.transform(F.sequence(F.lit(high[0]), F.lit(high[1])), lambda e: F.pow(F.lit(2.0), e).cast("long")))
    return first.select(names[0], second.alias(names[1])).where(condition(F.col(names[0]), F.col(names[1])))


def align_wall_clock(samples: DataFrame, runs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``wall``: seconds since the first start among all runs."""
    first = runs.agg(F.min("started_at").alias("s")).select("s").scalar()
    offset = F.timestamp_diff("SECOND", first, F.col("started_at")).cast("double")
    sized = meet(samples.groupBy("run_id").agg(last_seq()), runs.select("run_id", offset.alias("_off")), ["run_id"])
    return attach(samples, sized, ["run_id"], block_rows=block_rows).withColumn("wall", F.col("t") + F.col("_off")).drop("_off")
