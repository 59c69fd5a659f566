"""Windowed streaming aggregates.  The same functions run on static data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _slot(events: DataFrame, period_s: float):
    width = f"{int(round(period_s * 1e6))} microseconds"
    if events.isStreaming:
        # Watermarks want an instant; a time without zone counts as session time.
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{int(round(2 * period_s * 1e6))} microseconds")
    return events, F.window("ts", width)


def sync_sample_stream(events: DataFrame, period_s: float) -> DataFrame:
    """Last value of each key per sampling tick; a tick without a value has no row."""
    events, slot = _slot(events, period_s)
    out = events.groupBy(slot.alias("w"), "run_id", "metric").agg(F.max_by("value", "ts").alias("value"))
    return out.select("run_id", F.col("w.end").alias("tick"), "metric", "value")


def sample_per_period(events: DataFrame, period_s: float, row_id: str = "event_id") -> DataFrame:
    """One pseudo-random value per period and series: the row whose id has the smallest hash."""
    events, slot = _slot(events, period_s)
    # 60 bits of the hash as a number, which aggregates by hash where text would be sorted.
    rank = F.conv(F.substring(F.md5(F.col(row_id).cast("string")), 1, 15), 16, 10).cast("long")
    out = events.groupBy(slot.alias("w"), "run_id", "metric").agg(F.min_by("value", rank).alias("value"))
    return out.select("run_id", F.col("w.start").alias("period"), "metric", "value")


def latest(events: DataFrame, labels: list[str]) -> DataFrame:
    """Gauges: newest value per label set, with the number of readings."""
    return events.groupBy(*labels).agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"), F.count("*").alias("readings"))


def energy_totals(events: DataFrame, labels: list[str]) -> DataFrame:
    """Counters: total of already computed energy steps per label set."""
    return events.groupBy(*labels).agg(F.sum("step").alias("energy"))
