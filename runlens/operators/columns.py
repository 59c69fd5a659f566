"""Projections and schema work on samples and on run_columns(run_id, pos, raw_name, name, unit)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import common_prefix
from ..plans.blocks import BLOCK_ROWS, attach, last_seq, meet, number_rows

# Unit suffixes that the loader strips, and unit factors.
STRIPPED = ["ms", "s", "m°C", "°C", "Hz", "%"]
BASE_UNITS = {"m°C": ("°C", 1e-3), "mC": ("°C", 1e-3)}
REPORT_UNITS = {"mC": ("°C", 1e-3), "per-mille": ("%", 0.1), "Hz": ("MHz", 1e-6), "kHz": ("MHz", 1e-3),
                "GHz": ("MHz", 1e3), "uV": ("mV", 1e-3), "V": ("mV", 1e3)}
# Default report categories, substring to title.
CATEGORIES = {"temp": "Temperature", "load": "Load", "freq": "Frequency", "current": "Current",
              "voltage": "Voltage", "power": "Power", "cpu_work_done": "CPU work done"}
NO_UNIT = "no unit"
# Names of the time axis, which is the column ``t`` of all samples.
TIME = ("t", "time")


def split_units(run_columns: DataFrame, raw: str = "raw_name") -> DataFrame:
    """``name/unit`` headers to two columns."""
    parts = F.split(F.trim(F.col(raw)), "/")
    return (run_columns.withColumn("name", parts[0])
            .withColumn("unit", F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(NO_UNIT))))


def normalized_name(raw: Column) -> Column:
    """Header as an identifier: other characters become one ``_``, a leading digit gets one."""
    name = F.regexp_replace(raw, r"[^\p{L}\p{N}_°]+", "_")
    return F.when(name.rlike("^[0-9]"), F.concat(F.lit("_"), name)).otherwise(name)


def strip_units(run_columns: DataFrame, name: str = "name") -> DataFrame:
    """Drop a known unit suffix ``_unit`` from the name."""
    return run_columns.withColumn(name, F.regexp_replace(F.col(name), f"_({'|'.join(STRIPPED)})$", ""))


def _unit_case(units: dict, index: int, unit: Column, other: Column) -> Column:
    out = None
    for key, target in units.items():
        out = (F if out is None else out).when(unit == key, F.lit(target[index]))
    return out.otherwise(other)


def normalize_units(samples: DataFrame) -> DataFrame:
    """Milli-degrees to degrees (value and unit columns); of times only the time axis is brought to seconds, by the reader."""
    unit = F.col("unit")
    return (samples.withColumn("value", F.col("value") * _unit_case(BASE_UNITS, 1, unit, F.lit(1.0)))
            .withColumn("unit", _unit_case(BASE_UNITS, 0, unit, unit)))


def normalize_report_units(samples: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Report units; time and instruction counts scale by the largest value of the series."""
    keys = ["run_id", "metric"]
    peak = samples.groupBy(*keys).agg(F.max("value").alias("_peak"), last_seq())
    joined = attach(samples, peak, keys, block_rows=block_rows)
    unit, top = F.col("unit"), F.col("_peak")
    power = F.length(F.floor(top).cast("long").cast("string")) - 1
    ms, count = unit == "ms", unit == "Instructions executed"
    factor = (F.when(ms & (top > 7200000), F.col("value") / 3600000)
              .when(ms & (top > 120000), F.col("value") / 60000)
              .when(ms & (top > 2000), F.col("value") / 1000)
              .when(count, F.col("value") / F.pow(F.lit(10.0), power))
              .otherwise(F.col("value") * _unit_case(REPORT_UNITS, 1, unit, F.lit(1.0))))
    named = (F.when(ms & (top > 7200000), F.lit("hours")).when(ms & (top > 120000), F.lit("minutes"))
             .when(ms & (top > 2000), F.lit("seconds"))
             .when(count, F.concat(F.lit("10^"), power.cast("string"), F.lit(" instructions executed")))
             .otherwise(_unit_case(REPORT_UNITS, 0, unit, unit)))
    return joined.withColumn("value", factor).withColumn("unit", named).drop("_peak")


def select_metrics(df: DataFrame, contains: list[str] | None = None, regex: str | None = None,
                   name: str = "metric") -> DataFrame:
    """Rows whose name matches; with substrings one row per match and the substring's place in ``match``."""
    if regex is not None:
        return df.where(F.col(name).rlike(regex))
    hits = F.filter(F.array(*[F.struct(F.lit(i).alias("match"), F.lit(s).alias("s")) for i, s in enumerate(contains)]),
                    lambda p: F.contains(F.col(name), p["s"]))
    return df.select("*", F.explode(F.transform(hits, lambda p: p["match"])).alias("match"))


def scale(samples: DataFrame, x: float = 1.0, y: float = 1.0) -> DataFrame:
    return samples.withColumn("t", F.col("t") * x).withColumn("value", F.col("value") * y)


def default_scale(run_columns: DataFrame, raw: str = "raw_name") -> DataFrame:
    """Suggested factor per column and the run's default x column."""
    header = F.col(raw)
    milli = header.endswith("/m°C") | header.endswith("/mC") | header.endswith("/ms")
    per_run = run_columns.groupBy("run_id").agg(
        F.coalesce(F.max(F.when(header == "time/ms", header)), F.min(header)).alias("x_column"))
    return meet(run_columns.withColumn("scale", F.when(milli, F.lit(1e-3)).otherwise(F.lit(1.0))), per_run, ["run_id"])


def prune_columns(samples: DataFrame, keep: list[str], x: list[str]) -> DataFrame:
    """Listed metrics and those whose name contains an x-axis substring."""
    wanted = F.col("metric").isin(keep)
    for s in x:
        wanted = wanted | F.contains(F.col("metric"), F.lit(s))
    return samples.where(wanted)


def all_columns(run_columns: DataFrame) -> DataFrame:
    """Sorted union of the column names with the number of runs that have each."""
    return run_columns.groupBy("name").agg(F.countDistinct("run_id").alias("runs")).orderBy("name")


def runs_with(run_columns: DataFrame, name: str) -> DataFrame:
    return run_columns.where(F.col("name") == name).select("run_id").distinct()


def x_columns(run_columns: DataFrame, contains: list[str]) -> DataFrame:
    """Names matching the x-axis substrings with the unit of the first run that has them."""
    hit = F.lit(False)
    for s in contains:
        hit = hit | F.contains(F.col("name"), F.lit(s))
    return (run_columns.where(hit).groupBy("name")
            .agg(F.min_by("unit", F.struct("run_id", "pos")).alias("unit"), F.countDistinct("run_id").alias("runs")))


def by_category(samples: DataFrame, categories: dict[str, str], x: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Long table (run, x, category, metric, x value, y value): every row of a metric against its line's x value.

    A category that equals the x axis is left out, as is one no column falls in.
    """
    timed = x in TIME
    axis = samples.where(F.col("metric") == x).select("run_id", "seq", F.col("value").alias("x_value"))
    pairs = F.array(*[F.struct(F.lit(k).alias("pat"), F.lit(v).alias("category"))
                      for k, v in categories.items() if k != x])
    hits = F.filter(pairs, lambda p: F.contains(F.col("metric"), p["pat"]))
    placed = (samples.where((F.col("metric") != x) & F.col("value").isNotNull())
              .select("run_id", "seq", "metric", *([F.col("t").alias("x_value")] if timed else []), F.col("value").alias("y_value"),
                      F.explode(F.transform(hits, lambda p: p["category"])).alias("category")))
    return (placed if timed else meet(placed, axis, ["run_id", "seq"])).withColumn("x", F.lit(x))


def series_titles(fits: DataFrame, order: list[str] = ("name", "metric")) -> DataFrame:
    """Titles that show the run name and the column only where they differ over the result.

    Where both differ the row's number in ``order``, from 1, is added.
    """
    fits = number_rows(fits, [], list(order), "_no")
    same = fits.agg((F.min("name") == F.max("name")).alias("same_names"), (F.min("metric") == F.max("metric")).alias("same_cols"))
    names, cols = same.select("same_names").scalar(), same.select("same_cols").scalar()
    title = F.concat(
        F.when(~names | cols, F.col("name")).otherwise(F.lit("")),
        F.when(~names & ~cols, F.lit(", ")).otherwise(F.lit("")),
        F.when(cols, F.lit("")).otherwise(F.col("metric")),
        F.when(~names & ~cols, (F.col("_no") + 1).cast("string")).otherwise(F.lit("")))
    return fits.withColumn("title", title).drop("_no")


def result_title(runs: DataFrame, name: str = "name") -> DataFrame:
    """Longest common prefix of the run names, the default title of a result."""
    return runs.agg(common_prefix(F.col(name)).alias("title"))
