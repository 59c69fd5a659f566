"""Memory-benchmark text: ``size<TAB>r0<TAB>r1…<TAB>∑sum`` rows and ``CPUn size:S time:T`` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_membench(lines: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(results per size and thread, timings per CPU) from a table of lines; other columns are kept."""
    kept = [c for c in lines.columns if c != line]
    cells = F.split(line, "\t")
    rows = lines.where(F.col(line).rlike("^[0-9]+\t")).select(
        *kept, cells[0].cast("long").alias("size"), F.posexplode(F.slice(cells, F.lit(2), F.size(cells))).alias("thread", "cell"))
    results = rows.where(~F.col("cell").startswith("∑")).select(*kept, "size", "thread", F.expr("try_cast(cell as double)").alias("result"))
    pattern = r"^CPU([0-9]+) size:([0-9]+) time:(\S+)"
    timings = lines.where(F.col(line).rlike(pattern)).select(
        *kept, F.regexp_extract(line, pattern, 1).cast("int").alias("cpu"), F.regexp_extract(line, pattern, 2).cast("long").alias("size"),
        F.expr(f"try_cast(regexp_extract({line}, '{pattern.replace(chr(92), chr(92) * 2)}', 3) as double)").alias("time"))
    return results, timings


def read_membench(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return parse_membench(lines)
