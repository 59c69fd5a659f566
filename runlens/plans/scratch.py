"""Intermediate tables in the folder the cluster shares.

The folder is that of ``spark.checkpoint.dir``, else the one given to
``SparkContext.setCheckpointDir``.  Only a local session that has neither
gets a fresh one of its own; on a cluster a missing setting is an error,
because a machine-local folder would not survive the loss of an executor.
Tables stay until ``clear`` is called, since a retried job may read them again; a program of several steps
that stores each step's result by itself calls ``release`` to let go of what the step before has left.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_folder: dict[str, str] = {}
_made: dict[str, list[str]] = {}
_once: dict[tuple[str, str], str] = {}
_marks: dict[str, int] = {}
_here = threading.local()


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_folder:
        _local_folder[context.applicationId] = tempfile.mkdtemp(prefix="run-")
    return _local_folder[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if getattr(_here, "paths", None) is not None:
        _here.paths.append(path)
    else:
        _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread stores inside go at the end: what is made of them must be stored elsewhere by then."""
    outer, _here.paths = getattr(_here, "paths", None), []
    try:
        yield
    finally:
        inner, _here.paths = _here.paths, outer
        delete(spark, inner)


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the stored table; ``options`` are the writer's.

    Cuts the lineage and pins every nondeterministic column (partition ids,
    row ids) so that later branches of a plan agree on it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, label: str, make: Callable[[str], None]) -> str:
    """The path that ``make(path)`` fills, made once per application and ``label``."""
    key = (spark.sparkContext.applicationId, label)
    if key not in _once:
        path = scratch_path(spark, "once")
        make(path)
        _once[key] = path
    return _once[key]


def delete(spark: SparkSession, paths: list[str]) -> int:
    """Delete stored tables by their paths; returns their number."""
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(hadoop).delete(where, True)
    return len(paths)


def mark(spark: SparkSession) -> None:
    """Where the steps of a program begin: ``release`` does not touch what was stored before."""
    app = spark.sparkContext.applicationId
    _marks[app] = len(_made.setdefault(app, []))


def release(spark: SparkSession, source: DataFrame) -> int:
    """Delete the tables stored since the last ``mark`` or ``release``, but for those that ``source`` reads and those of ``once``; returns their number.

    Call it between two steps, with the stored result of the one before as ``source``: a retried job of a later step reads that
    result, never the tables it was made of.
    """
    app = spark.sparkContext.applicationId
    made = _made.setdefault(app, [])
    read = {file.rpartition("/")[0].partition(":")[2].lstrip("/") if ":" in file else file.rpartition("/")[0].lstrip("/") for file in source.inputFiles()}
    kept = {path for (owner, _), path in _once.items() if owner == app}
    kept |= {path for path in made if (path.partition(":")[2] if ":" in path else path).lstrip("/") in read}
    first = _marks.get(app)
    gone = [] if first is None else [path for path in made[first:] if path not in kept]
    _made[app] = [path for path in made if path not in {*gone}]
    _marks[app] = len(_made[app])
    return delete(spark, gone)


def clear(spark: SparkSession) -> int:
    """Delete this application's stored tables; call it when no result that reads them is in use.  Returns their number."""
    app = spark.sparkContext.applicationId
    paths = _made.pop(app, [])
    _marks.pop(app, None)
    for key in [k for k in _once if k[0] == app]:
        del _once[key]
    return delete(spark, paths)
