"""Row filters, truncation and run checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.blocks import last_seq


def pair(samples: DataFrame, metric: str) -> DataFrame:
    """(t, value) of one metric where both are known."""
    return samples.where((F.col("metric") == metric) & F.col("value").isNotNull() & F.col("t").isNotNull())


def truncate(samples: DataFrame, horizon: float) -> DataFrame:
    """Rows before ``horizon`` seconds."""
    return samples.where(F.col("t") < horizon)


def row_range(samples: DataFrame, low: float, high: float, div: float = 1.0) -> DataFrame:
    return samples.where((F.col("t") / div).between(low, high))


def horizon_sweep(samples: DataFrame, horizons: list[float]) -> DataFrame:
    """Each row once per horizon it falls under; the horizons are a short parameter list.

    Fits over many horizons do not need this: see ``fitting.fit_sweep``.
    """
    under = F.filter(F.array(*[F.lit(float(h)) for h in sorted(horizons)]), lambda h: F.col("t") < h)
    return samples.select("*", F.explode(under).alias("horizon"))


def validate_runs(run_columns: DataFrame, samples: DataFrame, first_cells: DataFrame | None = None) -> DataFrame:
    """Violations per run: first header not ``time/``, fewer than two columns, unknown first cells."""
    headers = run_columns.groupBy("run_id").agg(
        F.min_by("raw_name", "pos").alias("first"), F.count("*").alias("columns"))
    checks = [
        (~F.col("first").startswith("time/"), "first column is not time"),
        (F.col("columns") < 2, "fewer than two columns"),
    ]
    flags = F.filter(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks]), lambda x: x.isNotNull())
    of_headers = headers.select("run_id", F.explode(flags).alias("violation"))
    source = samples if first_cells is None else first_cells
    missing = (source.groupBy("run_id").agg(F.count_if(F.col("t").isNull()).alias("n")).where("n > 0")
               .select("run_id", F.lit("missing value in the first column").alias("violation")))
    return of_headers.unionByName(missing)


def series_extent(samples: DataFrame) -> DataFrame:
    """First and last known time of each series, in row order."""
    known = samples.where(F.col("value").isNotNull())
    return known.groupBy("run_id", "metric").agg(
        F.min_by("t", "seq").alias("t_first"), F.max_by("t", "seq").alias("t_last"), F.count("*").alias("n"), last_seq())


def time_range(samples: DataFrame) -> DataFrame:
    """One row: earliest first time and latest last time over all series."""
    return series_extent(samples).agg(F.min("t_first").alias("tmin"), F.max("t_last").alias("tmax"))
