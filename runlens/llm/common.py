"""What the operators of this subpackage share: tables, folds, bounded samples, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a task; a single longer text is handled alone.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(row_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id has no fold."""
    return F.crc32((F.col(row_id) if isinstance(row_id, str) else row_id).cast("string")) % folds


def held_out(row_id: Column | str, folds: int) -> Column:
    return F.coalesce(fold(row_id, folds) == 0, F.lit(False))


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def bounded_sample(labelled: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """At most ``rows`` rows, chosen by a hash of the key: the same rows wherever they are stored.

    The keys are ranked first, without the other columns, so that no text is
    gathered to choose the sample.
    """
    spread = F.xxhash64(F.col(key).cast("string"))
    keys = labelled.select(spread.alias("_h")).orderBy("_h").limit(rows)
    last = keys.agg(F.max("_h")).first()[0]
    if last is None:
        return labelled.limit(0)
    return labelled.where(spread <= F.lit(last)).limit(rows)


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch of about ``limit`` bytes of text each, with their texts (null: empty)."""
    column = batch.column(text)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            part = batch.slice(start, i - start)
            yield part, [t or "" for t in part.column(text).to_pylist()]
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        part = batch.slice(start)
        yield part, [t or "" for t in part.column(text).to_pylist()]


def map_texts(df: DataFrame, make: Callable[[pa.RecordBatch, list[str]], dict[str, pa.Array | np.ndarray]], schema: str,
              keep: list[str], limit: int = CHUNK_BYTES) -> DataFrame:
    """Columns computed from texts, in chunks of ``limit`` bytes; the columns of ``keep`` go through unchanged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, limit=limit):
                made = {k: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for k, v in make(part, texts).items()}
                kept = {k: part.column(k) for k in keep}
                yield pa.RecordBatch.from_pydict({**kept, **made})

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    kept = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return df.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{kept}, {schema}" if kept else schema)


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of a few packed rows while the block's jobs run."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
