"""Starting streams and writing their results."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.blocks import number_rows
from ..plans.scratch import scratch_path, temporary
from ..sources.runfiles import write_runs
from .stateful import Carried


def drain(stream: DataFrame | Carried, label: str, mode: str = "append") -> DataFrame:
    """Run the stream over all input there is and return what it wrote.

    In ``complete`` mode that is the last batch's answer.  In ``update`` mode each batch is
    kept with its number in ``batch``, newest last.
    """
    spark = stream.stream.sparkSession if isinstance(stream, Carried) else stream.sparkSession
    out, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    if isinstance(stream, Carried):
        stream.write(out, checkpoint).awaitTermination()
        return spark.read.schema(stream.schema()).parquet(out).select(*(f.name for f in spark.createDataFrame([], stream.schema()).schema))
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(out)
    else:
        def keep(batch: DataFrame, number: int) -> None:
            # A repeated batch overwrites its own folder.
            batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")
        query = writer.foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(f"{_ddl(stream)}, batch int" if mode == "update" else stream.schema).parquet(out)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def write_runs_stream(samples: DataFrame, columns: DataFrame, runs: DataFrame, path: str, checkpoint: str):
    """Append run files batch by batch; a batch that is run again replaces its own files."""
    def write(batch: DataFrame, number: int) -> None:
        with temporary(batch.sparkSession):
            numbered = number_rows(batch, ["run_id"], ["t", "metric", "value"], "seq")
            present = numbered.select("run_id").distinct()
            write_runs(numbered, columns.join(present, "run_id", "left_semi"), runs.join(present, "run_id", "left_semi"),
                       f"{path}/batch={number:08d}", mode="overwrite")

    return (samples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
