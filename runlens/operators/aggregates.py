"""Aggregations per run, per series and over result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import mean_est, ratio_err
from ..plans.blocks import BLOCK_ROWS, meet, ordered_scan
from .columns import TIME
from .windows import SERIES, ops_per_sec

CACHE_LINE = 64
# Bandwidth units by letter.
BANDWIDTH_UNITS = {"": 1, "K": 1024, "M": 1024**2, "G": 1024**3}


def mean_estimate(df: DataFrame, keys: list[str], value: str, alpha: float = 0.05, std_error: bool = False) -> DataFrame:
    est = mean_est(F.col(value), alpha, std_error)
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in est.items()])


def ops_est(samples: DataFrame, regex: str = "work_done", alpha: float = 0.05, drop_inf: bool = False,
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Work per second of a run: mean estimates of its work metrics added up, errors in quadrature."""
    each = mean_estimate(ops_per_sec(samples, regex, 1, drop_inf, block_rows), SERIES, "ops", alpha)
    return each.groupBy("run_id").agg(F.sum("val").alias("ops"), F.sqrt(F.sum(F.col("err") * F.col("err"))).alias("ops_err"))


def mean_speed(samples: DataFrame, regex: str = "work_done", drop_inf: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return ops_per_sec(samples, regex, 1, drop_inf, block_rows).groupBy(*SERIES).agg(F.avg("ops").alias("speed"))


def quantiles(df: DataFrame, value: str, probabilities: list[float], keys: list[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation between order statistics, per group of ``keys``.

    Equal values are counted first; their running counts give every rank, so no
    group is ever sorted or held as a whole in one place.
    """
    keys = list(keys)
    counts = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v"))
              .agg(F.count("*").alias("_c")))
    ranked = (ordered_scan(counts, keys, ["_v"])
              .total("_upto", F.col("_c")).rest("_from", F.col("_c")).result())
    last = F.col("_upto") + F.col("_from") - F.col("_c") - 1
    cells = []
    for i, p in enumerate(probabilities):
        at = last * F.lit(float(p))
        low, high = F.floor(at).cast("long"), F.ceil(at).cast("long")
        cells += [F.min(F.when(F.col("_upto") > low, F.col("_v"))).alias(f"_l{i}"),
                  F.min(F.when(F.col("_upto") > high, F.col("_v"))).alias(f"_h{i}"),
                  F.max(at - low).alias(f"_w{i}")]
    grouped = ranked.groupBy(*keys).agg(*cells)
    return grouped.select(*keys, *[(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_w{i}")).alias(f"q{i}")
                                   for i in range(len(probabilities))])


def flag_bad(fits: DataFrame, rmse: str = "rmse") -> DataFrame:
    """Marks fits whose rmse is above twice the third quartile of all."""
    q3 = quantiles(fits, rmse, [0.75]).select("q0").scalar()
    return fits.withColumn("bad", F.coalesce(F.col(rmse) > 2 * q3, F.lit(False)))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: count, missing, mean, std, min, quartiles, max."""
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v")) for c in columns])
    cells = df.select(F.inline(pairs))
    stats = cells.groupBy("variable").agg(
        F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("missing"), F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    parts = quantiles(cells, "v", [0.25, 0.5, 0.75], ["variable"])
    return stats.join(parts.toDF("variable", "q25", "median", "q75"), "variable", "left")


def histogram(df: DataFrame, column: str, nbins: int) -> DataFrame:
    """Counts in ``nbins`` even bins from the smallest to the largest finite value, empty bins included.

    Values that are not finite have rows of their own where there are any: bin -1 for -Infinity, ``nbins`` for
    Infinity, and no bin for NaN, with that value as ``low``.
    """
    infinity = F.lit(float("inf"))
    value = F.col(column).cast("double")
    known = df.where(value.isNotNull()).select(value.alias("_v"))
    finite = ~F.isnan("_v") & (F.abs("_v") != infinity)
    span = known.agg(F.min(F.when(finite, F.col("_v"))).alias("a"), F.max(F.when(finite, F.col("_v"))).alias("b"))
    low, high = span.select("a").scalar(), span.select("b").scalar()
    width = (high - low) / F.lit(float(nbins))
    place = F.when(width > 0, F.least(F.floor((F.col("_v") - low) / width), F.lit(nbins - 1))).otherwise(0)
    number = F.when(finite, place).when(F.col("_v") == infinity, nbins).when(F.col("_v") == -infinity, -1).cast("int")
    counted = known.groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
    inside = F.coalesce(F.col("bin").between(0, nbins - 1), F.lit(False))
    beyond = counted.where(~inside).select("bin", F.when(F.col("bin") == -1, -infinity).when(F.col("bin") == nbins, infinity).otherwise(float("nan")).alias("low"), "n")
    bins = df.sparkSession.range(nbins).select(F.col("id").cast("int").alias("bin"))
    return (bins.join(counted.where(inside), "bin", "left")
            .select("bin", (low + F.col("bin") * width).alias("low"), F.coalesce("n", F.lit(0).cast("long")).alias("n")).union(beyond))


def repeatability(fits: DataFrame, variant: str = "variant", value: str = "tinf") -> DataFrame:
    """Spread of a coefficient over repeated runs, per variant of the evaluation."""
    return fits.groupBy(variant).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def perf_per_temp(fits: DataFrame) -> DataFrame:
    """Work per second per degree with its error where the parts have one."""
    has_err = "tinf_err" in fits.columns
    err = ratio_err(F.col("ops"), F.col("ops_err"), F.col("tinf"), F.col("tinf_err") if has_err else F.lit(0.0))
    return fits.select("name", "metric", F.try_divide(F.col("ops"), F.col("tinf")).alias("perf"), err.alias("perf_err"))


def tinf_and_ops(fits: DataFrame, title: str = "performance") -> DataFrame:
    return fits.select("name", "metric", "tinf", F.col("ops").alias(title), F.col("ops_err").alias(f"{title}_err"))


def coverage(samples: DataFrame, categories: dict[str, str], x: list[str]) -> DataFrame:
    """Runs against categories per x axis: ``yes`` where the run has such a series, else ``N/A``.

    Works on distinct (run, metric) pairs, so the size is that of the catalogue.
    """
    have = samples.where(F.col("value").isNotNull()).select("run_id", "metric").distinct()
    axes = have.where(F.col("metric").isin(x)).select("run_id", F.col("metric").alias("x"))
    for name in x:
        if name in TIME:  # every run has it
            axes = axes.union(have.select("run_id", F.lit(name).alias("x")).distinct())
    pairs = F.array(*[F.struct(F.lit(k).alias("pat"), F.lit(v).alias("category")) for k, v in categories.items()])
    hits = F.filter(pairs, lambda p: F.contains(F.col("metric"), p["pat"]))
    cats = have.select("run_id", "metric", F.inline(hits))
    seen = meet(cats, axes, ["run_id"]).where((F.col("metric") != F.col("x")) & (F.col("pat") != F.col("x")))
    grid = meet(axes, seen.select("run_id", "x", "category").distinct(), ["run_id", "x"], "left")
    table = grid.groupBy("x", "run_id").pivot("category", list(categories.values())).agg(F.first(F.lit("yes")))
    return table.select("x", "run_id", *[F.coalesce(F.col(f"`{c}`"), F.lit("N/A")).alias(c) for c in categories.values()])


def memory_bandwidth(times: DataFrame, unit: str = "M") -> DataFrame:
    """Latency per access to bandwidth, added up over the threads of each working-set size."""
    rate = F.try_divide(F.lit(float(CACHE_LINE)), F.col("ns")) * 1e9 / float(BANDWIDTH_UNITS[unit])
    return times.groupBy("size").agg(F.count("*").alias("threads"), F.sum(rate).alias("bandwidth"), F.avg("ns").alias("latency"))


def bar_table(df: DataFrame, label: str, columns: list[str], errors: dict[str, str] | None = None) -> DataFrame:
    """Label and (value, error) pairs; a column without error gets NaN."""
    errors = errors or {}
    cells: list[Column] = []
    for c in columns:
        err = F.col(errors[c]) if c in errors else F.lit(float("nan"))
        cells += [F.col(c).cast("double").alias(c), err.cast("double").alias(f"{c}_err")]
    return df.select(F.col(label).cast("string").alias("label"), *cells)
