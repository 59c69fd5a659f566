"""The given tables seen as run data.

``events`` has the shape of sparse run files: each row is a time and one
populated metric.  ``lineitem`` stands in for memory-benchmark results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.blocks import BLOCK_ROWS, Scan, attach, number_rows

NAMES = {"view": "ambient", "click": "cpu_0_temp", "purchase": "cpu_1_temp", "signup": "cam_cpu", "error": "work_done"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def long_view(spark: SparkSession, sf_dir: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """samples(run_id, seq, t, metric, value) with user as run and event type as metric."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), micros(F.col("ts")).alias("us"), "event_id",
        F.col("event_type").alias("metric"), "value")
    numbered = number_rows(events, ["run_id"], ["us", "event_id"])
    start = events.groupBy("run_id").agg(F.min("us").alias("us0"), (F.count("*") - 1).alias("last_seq"))
    timed = attach(numbered, start, ["run_id"], block_rows=block_rows)
    return timed.select("run_id", "seq", ((F.col("us") - F.col("us0")) / F.lit(1e6)).alias("t"), "metric", "value", "event_id")


def sensor_view(spark: SparkSession, sf_dir: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The same rows under sensor names; ``work_done`` is the running sum of its values."""
    mapping = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    named = long_view(spark, sf_dir, block_rows).withColumn("metric", mapping[F.col("metric")])
    work = F.when(F.col("metric") == "work_done", F.col("value"))
    summed = Scan(named, ["run_id"], ["seq"], block_rows=block_rows).total("_w", work).result()
    value = F.when(F.col("metric") == "work_done", F.col("_w")).otherwise(F.col("value"))
    return summed.withColumn("value", value).drop("_w")


def counter_view(spark: SparkSession, sf_dir: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Cumulative CPU counters: running sums per event type as whole numbers."""
    source = {"user": "view", "nice": "click", "system": "purchase", "idle": "signup", "iowait": "error"}
    rows = long_view(spark, sf_dir, block_rows)
    scan = Scan(rows, ["run_id"], ["seq"], block_rows=block_rows)
    for counter, metric in source.items():
        scan.total(counter, F.when(F.col("metric") == metric, F.floor("value").cast("long")))
    out = scan.result()
    zero = F.lit(0).cast("long")
    rest = ["irq", "softirq", "steal", "guest", "guest_nice"]
    return out.select("run_id", F.lit(0).alias("cpu"), "seq", "t", *[F.coalesce(c, zero).alias(c) for c in source],
                      *[zero.alias(c) for c in rest])


def line_view(spark: SparkSession, sf_dir: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """lines(run_id, seq, t, line): ``type=value`` text; sign-ups are plain text."""
    text = F.when(F.col("metric") == "signup", F.concat(F.lit("note "), F.col("event_id").cast("string"))).otherwise(
        F.concat("metric", F.lit("="), F.col("value").cast("string")))
    return long_view(spark, sf_dir, block_rows).select("run_id", "seq", "t", text.alias("line"))


def memory_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.select(F.col("l_suppkey").alias("size"), F.col("l_linenumber").alias("thread"),
                        (F.col("l_extendedprice") / F.col("l_quantity")).alias("ns"))
