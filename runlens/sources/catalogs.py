"""Sensor lists: ``FILE [NAME [UNIT]]`` lines, ``#`` comments, ``!`` command specs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name


def parse_sensor_lines(lines: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(sensors, commands) from a table of sensor-list lines; other columns are kept.

    An unnamed sensor is called after the folder of its file.
    """
    kept = [c for c in lines.columns if c != line]
    used = lines.where(~F.col(line).startswith("#") & (F.trim(line) != ""))
    words = F.split(F.trim(line), r"\s+")
    folder = base_name(F.regexp_replace(words[0], "/[^/]*$", ""))
    name, unit = F.coalesce(F.try_element_at(words, F.lit(2)), folder), F.try_element_at(words, F.lit(3))
    sensors = used.where(~F.col(line).startswith("!")).select(
        *kept, words[0].alias("path"), name.alias("name"), unit.alias("unit"),
        F.when(unit.isNull(), name).otherwise(F.concat(name, F.lit("/"), unit)).alias("raw_name"))
    spec = F.substring(line, F.lit(2), F.length(line))
    listed = F.regexp_extract(spec, r"^\(([^)]*)\)", 1)
    first_word = F.regexp_extract(spec, r"^(\S+)", 1)
    column = F.explode(F.when(spec.startswith("("), F.filter(F.split(listed, ","), lambda s: s != "")).otherwise(F.array(first_word)))
    commands = used.where(F.col(line).startswith("!")).select(*kept, F.regexp_replace(spec, r"^\([^)]*\)", "").alias("command"), column.alias("spec"))
    bare = F.regexp_replace("spec", "^@", "")
    commands = commands.select(*kept, F.trim("command").alias("command"), F.regexp_replace(bare, "=$", "").alias("column"),
                               F.col("spec").startswith("@").alias("sync"), (~bare.endswith("=")).alias("catch_all"))
    return sensors, commands


def read_sensor_catalog(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """The same from files, with the file name's ending as ``testbed``."""
    lines = spark.read.text(paths).select(F.element_at(F.split(base_name(F.col("_metadata.file_path")), r"\."), -1).alias("testbed"),
                                          F.col("value").alias("line"))
    return parse_sensor_lines(lines)


def with_catalog_units(run_columns: DataFrame, sensors: DataFrame) -> DataFrame:
    """Units from the catalogue for columns whose header names none; where both tables tell the testbed, from its own list."""
    on = ["testbed", "name"] if "testbed" in run_columns.columns and "testbed" in sensors.columns else ["name"]
    units = F.collect_set("unit")  # of one sensor
    known = sensors.groupBy(*on).agg(F.when(F.size(units) == 1, units[0]).alias("_unit"))
    return (run_columns.join(known, on, "left")
            .withColumn("unit", F.when(F.col("unit") == "no unit", F.coalesce("_unit", "unit")).otherwise(F.col("unit"))).drop("_unit"))
