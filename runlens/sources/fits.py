"""Fit tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def flat(fits: DataFrame) -> DataFrame:
    """Only the columns a flat file can hold."""
    return fits.select(*[f.name for f in fits.schema if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))])


def write_fits(fits: DataFrame, path: str, format: str = "csv", mode: str = "errorifexists") -> None:
    writer = flat(fits).write.mode(mode)
    if format == "csv":
        writer.option("header", "true").option("escape", '"').csv(path)
    else:
        writer.format(format).save(path)
