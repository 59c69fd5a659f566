"""Tables behind the figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import general_format
from ..functions.text import fit_text
from ..plans.blocks import BLOCK_ROWS
from .aggregates import bar_table, flag_bad
from .columns import TIME, by_category, series_titles
from .fitting import fit_curves
from .joins import align_runs, compare_tinf
from .windows import decimate


def series_table(samples: DataFrame, metrics: list[str], minutes: bool = False) -> DataFrame:
    """Raw points of the metrics, unknown values dropped."""
    div = 60.0 if minutes else 1.0
    return (samples.where(F.col("metric").isin(metrics) & F.col("value").isNotNull())
            .select("run_id", "metric", "seq", (F.col("t") / div).alias("t"), "value"))


def rmse_note(rmse: Column, bad: Column) -> Column:
    """(±0.31) with marks on a bad fit."""
    return F.concat(F.lit("(±"), general_format(rmse, 2), F.when(bad, F.lit(" !!!")).otherwise(F.lit("")), F.lit(")"))


def fit_tables(fits: DataFrame, samples: DataFrame, pt_decim: int = 1, minutes: bool = True, n: int = 500,
               block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decimated points, model curves and legend rows of a multi-fit figure."""
    div = 60.0 if minutes else 1.0
    keys = fits.select("run_id", "metric").distinct()
    metrics = keys.select("metric").distinct()
    points = decimate(samples.join(metrics, "metric", "left_semi"), pt_decim, block_rows)
    points = points.select("run_id", "metric", "seq", (F.col("t") / div).alias("t"), "value")
    curves = fit_curves(fits, n).withColumn("t", F.col("t") / div)
    legend = (flag_bad(series_titles(fits))
              .withColumn("text", fit_text(F.col("tinf"), F.col("terms"), minutes))
              .withColumn("note", rmse_note(F.col("rmse"), F.col("bad")))
              .select("run_id", "metric", "title", "text", "note", "bad"))
    return points, curves, legend


def category_table(samples: DataFrame, categories: dict[str, str], x: str) -> DataFrame:
    return by_category(samples, categories, x).select("run_id", "x", "category", "metric", "seq", "x_value", "y_value")


def column_table(samples: DataFrame, metric: str, x: str) -> DataFrame:
    """One column of all runs against x, which is a metric or the time (``t``); the x column itself and text columns have none."""
    if (x in metric if x not in TIME else metric in TIME) or "stdout" in metric:
        return align_runs(samples.where(F.lit(False)), "t" if x in TIME else x, metric)
    return align_runs(samples, "t" if x in TIME else x, metric)


def tinf_bars(*results: DataFrame, on: list[str] = ("name", "metric"), labels: list[str] | None = None) -> DataFrame:
    labels = labels or [f"tinf_{i + 1}" for i in range(len(results))]
    return bar_table(compare_tinf(*results, on=on, labels=labels), "name", labels)


def tinf_ops_bars(fits: DataFrame) -> DataFrame:
    return bar_table(fits, "name", ["tinf", "ops"], {"ops": "ops_err"})
