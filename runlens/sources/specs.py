"""Declarative series specs: JSON files that list which column of which run to show, how scaled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.columns import TIME
from ..plans.blocks import BLOCK_ROWS, Scan, attach, last_seq, rolling

# Fixed value: the widest smoothing window the setting allows.
WIDEST = 100

RECORD = ("data_path string, x_col_name string, x_scale double, y_col_name string, y_scale double, y_label string, color string, "
          "linestyle string, y_subtract string, y_subtract_scale double, smoothing_window_size int")
SCHEMA = f"x_axis_title string, y_axis_title string, figure_title string, list_of_records array<struct<{RECORD.replace(' string', ': string').replace(' double', ': double').replace(' int', ': int')}>>"
FIELDS = [f.split()[0] for f in RECORD.split(", ")]


def read_specs(spark: SparkSession, paths) -> DataFrame:
    """One row per record; data paths are taken relative to their spec file."""
    raw = spark.read.schema(SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true").json(paths)
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    rows = raw.select(F.col("_metadata.file_path").alias("spec_file"), folder.alias("folder"), "x_axis_title", "y_axis_title", "figure_title",
                      F.posexplode("list_of_records").alias("spec_no", "r")).select("*", "r.*").drop("r")
    path = F.when(F.col("data_path").startswith("/") | F.col("data_path").contains(":/"), F.col("data_path")).otherwise(
        F.concat("folder", F.lit("/"), "data_path"))
    return rows.withColumn("data_path", path).drop("folder")


def write_specs(specs: DataFrame, path: str, titles=("x_axis_title", "y_axis_title", "figure_title"), folder: str | None = None) -> None:
    """One JSON file per figure; data paths become relative to ``folder``."""
    out = specs
    if folder is not None:
        prefix = folder.rstrip("/") + "/"
        cut = F.col("data_path").startswith(prefix)
        out = out.withColumn("data_path", F.when(cut, F.substring("data_path", F.lit(len(prefix) + 1), F.length("data_path"))).otherwise(F.col("data_path")))
    record = F.struct("spec_no", F.struct(*FIELDS).alias("r"))
    # A figure holds the few records a person has drawn.
    which = [c for c in ("spec_file",) if c in out.columns]  # equal titles don't make one figure of two files
    documents = out.groupBy(*which, *titles).agg(F.transform(F.array_sort(F.collect_list(record)), lambda x: x["r"]).alias("list_of_records"))
    figure = F.md5(F.concat_ws("|", *which, *titles)).alias("figure")
    documents.select(F.to_json(F.struct(*titles, "list_of_records")).alias("value"), figure).write.partitionBy("figure").text(path)


def apply_specs(samples: DataFrame, specs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Points of every spec: (run, spec_no, label, seq, x, y), all specs in one plan.

    ``samples.run_id`` is matched with ``specs.data_path``, block by block.  The x axis is the time, or the metric
    that ``x_col_name`` names: the points are then the lines that have both.  Where a column is
    subtracted both columns are interpolated on every row of the run with held
    edges; smoothing is a trailing mean over the points, at most ``WIDEST`` of them.
    """
    named = F.col("x_col_name") if "x_col_name" in specs.columns else F.lit(None).cast("string")
    x_metric = F.when(~F.split(F.trim(named), "/")[0].isin(*TIME), F.split(F.trim(named), "/")[0])
    settings = {"x_metric": x_metric, "x_scale": F.coalesce("x_scale", F.lit(1.0)), "y_col_name": F.col("y_col_name"), "y_subtract": F.col("y_subtract"),
                "y_scale": F.coalesce("y_scale", F.lit(1.0)), "sub_scale": F.coalesce("y_subtract_scale", F.lit(1.0)),
                "label": F.col("y_label"), "width": F.col("smoothing_window_size")}
    ends = samples.groupBy("run_id").agg(last_seq())
    key = specs.select(F.col("data_path").alias("run_id"), "spec_no", *[c.alias(n) for n, c in settings.items()]).join(ends, "run_id")
    keys, carried = ["run_id", "spec_no"], list(settings)
    joined = attach(samples, key, ["run_id"], block_rows=block_rows)
    of = lambda name: F.max(F.when(F.col("metric") == F.col(name), F.col("value")))
    rows = joined.groupBy(*keys, "seq", *carried).agg(F.min("t").alias("t"), of("y_col_name").alias("_y"), of("y_subtract").alias("_s"), of("x_metric").alias("_x"))
    rows = rows.withColumn("x", F.when(F.col("x_metric").isNull(), F.col("t")).otherwise(F.col("_x")))
    plain = rows.where("y_subtract is null").select(*keys, "seq", *carried, "x", (F.col("_y") * F.col("y_scale")).alias("y"))
    scan = Scan(rows.where("y_subtract is not null"), keys, ["seq"], block_rows=block_rows)
    for c in ("_y", "_s"):
        known = {"x": F.col("x"), "v": F.col(c)}
        there = F.col(c).isNotNull() & F.col("x").isNotNull()
        scan.last(f"{c}p", known, there).next(f"{c}n", known, there)
    near = scan.result()

    def held(c):
        p, n = F.col(f"{c}p"), F.col(f"{c}n")
        slope = F.try_divide((n["v"] - p["v"]) * (F.col("x") - p["x"]), n["x"] - p["x"])
        return F.coalesce(F.col(c), p["v"] + slope, p["v"], n["v"])

    minus = near.select(*keys, "seq", *carried, "x", (held("_y") * F.col("y_scale") - held("_s") * F.col("sub_scale")).alias("y"))
    points = plain.unionByName(minus).where("x is not null and y is not null").select(*keys, "seq", (F.col("x") * F.col("x_scale")).alias("x"), "y", "label", "width")
    raw = points.where("width is null").drop("width")
    placed = Scan(points.where("width is not null"), keys, ["seq"], block_rows=block_rows).total("_pos", F.lit(1).cast("long")).result()
    latest = rolling(placed.withColumn("_pos", F.col("_pos") - 1), keys, "_pos", "_last", lambda: F.collect_list("y"), WIDEST, block_rows)
    width = F.when(F.col("width").between(1, WIDEST), F.col("width")).otherwise(F.raise_error(F.lit(f"smoothing width not in 1 to {WIDEST}")))
    tail = F.slice("_last", F.greatest(F.size("_last") - width + 1, F.lit(1)), width)
    mean = F.aggregate(tail, F.lit(0.0), lambda s, y: s + y) / F.size(tail)
    return raw.unionByName(latest.select(*keys, "seq", "x", mean.alias("y"), "label"))
