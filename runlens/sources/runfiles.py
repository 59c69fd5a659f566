"""Run files: a comment line, a header line, sparse CSV rows; every file has its own columns.

Files are read as text, so that each keeps its header.  A file may be cut into
many blocks; one small row per block carries the line offset and the header,
and the lines meet it by (file, block).  The lines themselves are not shuffled
while that table is small enough to broadcast, and spread by block otherwise,
so one huge file is no hot spot.  ``MANY`` files or more on a disk are opened once, by the tasks themselves, and
their lines stored: opening a file takes Spark's reader some milliseconds, twice.

Line breaks inside quoted cells.  Whether a line starts a record depends on all lines of the file before it.  So each block
tells whether it ends inside a cell for both states it may begin in, and these maps are composed over a file's
blocks, one small row each.  Blocks without such cells go on as they are; in the others lines are joined to records,
also over cuts.
"""

from __future__ import annotations

import os
import re
import unicodedata
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import partial
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import general_format
from ..functions.text import base_name
from ..operators.columns import BASE_UNITS, NO_UNIT, _unit_case
from ..plans.blocks import BLOCK_ROWS, attach, block_of, last_seq, meet
from ..plans.scratch import delete, written

# The parts of the comment line.
STARTED = "Started at: (....-..-.. ..:..:..)"
ZONE = "Started at: ....-..-.. ..:..:.. ([+-][0-9]{4})"
VERSION = "Version: ([^,]*)"
COMMAND = "Generated by: (.*)"

# A cell after its comma: quoted with doubled quotes, or bare.
CELL = r',("[^"]*+(?:""[^"]*+)*+"|[^,]*+)'
RUN_FOLDER = "/run_id=([^/]+)/"
# A line, read from the start of a record, whose last cell opens quotes and leaves them open.
LEAVES_OPEN = r'^(?:(?:"[^"]*+(?:""[^"]*+)*+"|[^",][^,]*+)?+,)*+"[^"]*+(?:""[^"]*+)*+$'
# What Spark writes as %XX in the name of a partition's folder, and its name for NULL and empty text.
IN_FOLDER = re.compile("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]")
NO_NAME = "__HIVE_DEFAULT_PARTITION__"
# Listing tasks per core: Spark's own number (10,000) costs more than listing a folder.
LISTINGS = 8
MANY = 1000
# Entries that a task lists below a folder before it hands on the rest.
LISTED = 1000
CUT_BYTES = 32 << 20  # of one block of a file on a disk
SENT_BYTES = 1 << 20
MARK = b"\xef\xbb\xbf"
# Characters that stand for themselves in a file's URI, besides those beyond ASCII.
IN_URI = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_.!~*'():@&=+$,;/")
PACKED = r"\.(gz|gzip|bz2|deflate|lz4|snappy|zst|xz|lzo)$"  # left to Spark's reader
# A line of a whole file; line breaks inside quotes belong to it.
RECORD = r'(?:[^"\n]|"[^"]*+(?:""[^"]*+)*+")+'


@dataclass
class RunSet:
    """samples(run_id, seq, t, metric, unit, value, text), columns(run_id, pos, raw_name, name, unit), runs(...)."""

    samples: DataFrame
    columns: DataFrame
    runs: DataFrame


def split_cells(line: Column) -> Column:
    """CSV cells of a line, unquoted."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CELL), F.lit(1))
    return F.transform(cells, lambda c: F.when(
        c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def csv_cell(value: Column) -> Column:
    """Quote a cell that holds a comma, quote or line break; embedded quotes are doubled."""
    return F.when(value.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def _no_return(line: Column) -> Column:
    """Without the carriage return of its line end."""
    return F.when(line.endswith("\r"), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)


def _optional(text: Column) -> Column:
    return F.when(text != "", text)


def run_metadata(lines: DataFrame, comment: str = "comment") -> DataFrame:
    """started_at, zone, version and command from comment lines; NULL where absent."""
    c = F.col(comment)
    return (lines.withColumn("started_at", F.try_to_timestamp(_optional(F.regexp_extract(c, STARTED, 1)), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))
            .withColumn("zone", _optional(F.regexp_extract(c, ZONE, 1)))
            .withColumn("version", _optional(F.regexp_extract(c, VERSION, 1)))
            .withColumn("command", _optional(F.regexp_extract(c, COMMAND, 1))))


def with_name(runs: DataFrame, name: str | None = None, **meta: str) -> DataFrame:
    """Label the runs (file base name by default) and keep extra facts in ``meta``."""
    label = F.lit(name) if name is not None else F.coalesce(base_name(F.col("filename")), F.lit(""))
    extra = F.create_map(*[F.lit(str(x)) for pair in meta.items() for x in pair]) if meta else F.expr("cast(map() as map<string,string>)")
    own = F.map_filter(F.create_map(
        F.lit("filename"), F.col("filename"), F.lit("datetime"), F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"),
        F.lit("version"), F.col("version"), F.lit("command"), F.col("command")), lambda k, v: v.isNotNull())
    kept = F.map_filter(extra, lambda k, v: ~F.map_contains_key(own, k))
    return runs.withColumn("name", label).withColumn("meta", F.map_concat(kept, own))


def rename(runs: DataFrame, run_id, name: str) -> DataFrame:
    return runs.withColumn("name", F.when(F.col("run_id") == run_id, F.lit(name)).otherwise(F.col("name")))


@contextmanager
def few_listings(spark: SparkSession) -> Iterator[None]:
    """While it holds, files are found by a few tasks per core."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    saved = spark.conf.get(name)
    spark.conf.set(name, str(min(int(saved), LISTINGS * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, saved)


def _file_uri(path: str) -> str:
    """The name that Spark gives a file on the disk."""
    odd = lambda c: c not in IN_URI if c.isascii() else unicodedata.category(c) in ("Zs", "Zl", "Zp", "Cc")
    return "file:" + "".join("".join(f"%{b:02X}" for b in c.encode()) if odd(c) else c for c in path)


def _hidden(name: str) -> bool:
    """Names that Spark passes over."""
    if name.startswith(("_common_metadata", "_metadata")):
        return False
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def _many(tops: list[str]) -> bool:
    names = (name for top in tops for _, _, files in os.walk(top, followlinks=True) for name in files)
    return sum(1 for _ in islice(names, MANY)) == MANY


def _list_some(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(path, size) of files below the given folders, and with size -1 the folders not yet listed."""
    for batch in batches:
        found = []
        for top in batch.column(0).to_pylist():
            todo, listed = [top], 0
            while todo and listed < most:
                with os.scandir(todo.pop()) as entries:
                    for e in entries:
                        listed += 1
                        if _hidden(e.name):
                            continue
                        if e.is_dir():
                            todo.append(e.path)
                        else:
                            found.append((e.path, e.stat().st_size))
            found += [(folder, -1) for folder in todo]
        yield pa.RecordBatch.from_pydict({"path": pa.array([f[0] for f in found], pa.string()), "size": pa.array([f[1] for f in found], pa.int64())})


def _listed(spark: SparkSession, tops: list[str], most: int = LISTED) -> DataFrame:
    """(path, size) of all files below the folders, listed by tasks; stored."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = spark.createDataFrame([(p, os.path.getsize(p)) for p in tops if os.path.isfile(p) and not _hidden(os.path.basename(p))], "path string, size long")
    left = spark.createDataFrame([(p,) for p in tops if os.path.isdir(p)], "path string").coalesce(1)
    while True:
        found = written(left.mapInArrow(partial(_list_some, most=most), "path string, size long"), "listing")
        files = files.unionByName(found.where("size >= 0"))
        left = found.where("size < 0").select("path")
        if not left.take(1):
            return files
        left = left.repartition(tasks, "path")


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the run files below a folder.  On a disk tasks list them, so that the driver holds no list."""
    top = _local_path(spark, path)
    if top is not None and os.path.isdir(top):
        return _listed(spark, [top]).agg(F.sum("size")).first()[0] or 0
    with few_listings(spark):
        text = spark.read.option("recursiveFileLookup", "true").text(path)
    return text.agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of blocks (path, start, end): those that begin in the block."""
    names, starts, lines, held = [], [], [], 0
    schema = pa.schema([("run_id", pa.string()), ("file", pa.string()), ("start", pa.int64()), ("line", pa.binary())])

    def sent() -> pa.RecordBatch:
        runs = [None if (m := re.search(RUN_FOLDER, n)) is None else m[1] for n in names]
        counts = [len(x) for x in lines]
        each = pa.array([i for i, n in enumerate(counts) for _ in range(n)], pa.int64())
        files = pa.array(names, pa.string())
        return pa.RecordBatch.from_arrays([pa.array(runs, pa.string()).take(each), files.take(each), pa.array(starts, pa.int64()).take(each),
                                           pa.array([line for x in lines for line in x], pa.binary())], schema=schema)

    for batch in batches:
        for path, start, end in zip(*(batch.column(i).to_pylist() for i in range(3))):
            name, at = _file_uri(path), max(0, start - 1)
            with open(path, "rb") as file:
                file.seek(at)
                if start:
                    at += len(file.readline())
                while at < end:
                    some = file.readlines(min(SENT_BYTES, end - at))
                    if not some:
                        break
                    # The last lines may begin behind the end of the block.
                    read = at
                    for n, line in enumerate(some):
                        if read >= end:
                            del some[n:]
                            break
                        read += len(line)
                    if not at and some[0].startswith(MARK):
                        some[0] = some[0][len(MARK):]
                    at = read
                    names.append(name)
                    starts.append(start)
                    lines.append([x[:-1] if x.endswith(b"\n") else x for x in some])
                    held += sum(map(len, some))
                    if held >= SENT_BYTES:
                        yield sent()
                        names, starts, lines, held = [], [], [], 0
    if lines:
        yield sent()


def _stored_lines(spark: SparkSession, tops: list[str], cut_bytes: int = CUT_BYTES, most: int = LISTED) -> DataFrame | None:
    """Lines of files on the disk, read by tasks that open each file once; none if a file is compressed."""
    files = _listed(spark, tops, most)
    if files.where(F.lower("path").rlike(PACKED)).take(1):
        return None
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(cut_bytes).cast("long")))
    blocks = files.where("size > 0").select("path", "size", cuts.alias("start")).select("path", "start", F.least("size", F.col("start") + cut_bytes).alias("end"))
    spread = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")
    read = spread.mapInArrow(_read_files, "run_id string, file string, start long, line binary")
    run = F.coalesce(_optional(F.col("run_id")), F.col("file"))
    return written(read.select(run.alias("run_id"), "file", "start", F.monotonically_increasing_id().alias("id"), F.col("line").cast("string").alias("line")), "lines")


def _lines(spark: SparkSession, paths) -> DataFrame:
    given = [paths] if isinstance(paths, str) else list(paths)
    tops = [None if re.search(r"[{}\[\]*?\\]", p) else _local_path(spark, p) for p in given]
    apart = all(p is not None and os.path.exists(p) for p in tops) and not any(
        a == b or b.startswith(f"{a}/") for i, a in enumerate(tops) for j, b in enumerate(tops) if i != j)
    if tops and apart and _many(tops):
        stored = _stored_lines(spark, tops)
        if stored is not None:
            return stored
    with few_listings(spark):
        text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(paths)
    file = F.col("_metadata.file_path")
    run = F.coalesce(_optional(F.regexp_extract(file, RUN_FOLDER, 1)), file)
    return text.select(run.alias("run_id"), file.alias("file"), F.col("_metadata.file_block_start").alias("start"),
                       F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))


def _toggles(comment: str) -> tuple[Column, Column]:
    """Of a line: whether it turns 'inside a cell' over, and whether it ends any cell and opens none."""
    odd = (F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))) % 2 == 1
    turns = odd & ~F.col("line").startswith(comment) & F.col("line").rlike(LEAVES_OPEN)
    return turns, odd & ~turns


def _block_table(lines: DataFrame, comment: str) -> DataFrame:
    """One row per block: its lines, the first line that is no comment, comments, and lines with an open quote (by number; at most the block's lines)."""
    body = ~F.col("line").startswith(comment)
    turns, ends = _toggles(comment)
    return lines.groupBy("run_id", "file", "start").agg(
        F.min("id").alias("first_id"), F.count("*").alias("lines"), F.count_if(body).alias("bodies"),
        F.min(F.when(body, F.col("id"))).alias("body_id"), F.min_by("line", F.when(body, F.col("id"))).alias("body_line"),
        F.min_by("line", F.when(~body, F.col("id"))).alias("note"),
        F.sort_array(F.collect_list(F.when(~body, F.col("id")))).alias("notes"),
        F.sort_array(F.collect_list(F.when(turns | ends, F.struct("id", turns.alias("turns"))))).alias("odd"))


def _opened(blocks: DataFrame) -> DataFrame:
    """Adds ``inside``: 1 if the block begins inside a quoted cell; and ``touched``: it has to be cut into records."""
    after = lambda begin: F.aggregate("odd", F.lit(begin), lambda s, x: F.when(x["turns"], 1 - s).otherwise(0))
    earlier = W.partitionBy("run_id", "file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    told = blocks.withColumn("_out", after(0)).withColumn("_in", after(1))
    turned = told.withColumn("_turned", F.coalesce(F.sum((F.col("_out") > F.col("_in")).cast("int")).over(earlier), F.lit(0)))
    settled = F.when(F.col("_out") == F.col("_in"), F.struct(F.col("_out").alias("state"), F.col("_turned").alias("turned")))
    last = turned.withColumn("_last", F.last(settled, ignorenulls=True).over(earlier))
    inside = F.coalesce(F.col("_last.state") + F.col("_turned") - F.col("_last.turned"), F.col("_turned")) % 2
    return (last.withColumn("inside", inside).withColumn("touched", (F.size("odd") > 0) | (F.col("inside") == 1))
            .drop("_out", "_in", "_turned", "_last"))


def _records(lines: DataFrame, blocks: DataFrame, comment: str) -> DataFrame:
    """The records of the touched blocks, as lines are: numbered densely in the block in which they begin.

    A cell that is never closed goes on to the end of its file.
    """
    turns, ends = _toggles(comment)
    here = ["file", "start"]
    row = W.partitionBy(*here).orderBy("id")
    before = row.rowsBetween(W.unboundedPreceding, -1)
    told = (lines.join(blocks.where("touched").select(*here, "inside", "first_id"), here).withColumn("_turns", turns.cast("int")).withColumn("_ends", ends)
            .withColumn("_turned", F.coalesce(F.sum("_turns").over(before), F.lit(0)).cast("int")))
    told = told.withColumn("_ended", F.last(F.when(F.col("_ends"), F.col("_turned")), ignorenulls=True).over(before))
    told = told.withColumn("_state", F.coalesce(F.col("_turned") - F.col("_ended"), F.col("_turned") + F.col("inside")) % 2)
    after = F.when(F.col("_ends"), 0).otherwise((F.col("_state") + F.col("_turns")) % 2)
    told = told.withColumn("_no", F.sum((F.col("_state") == 0).cast("long")).over(row.rowsBetween(W.unboundedPreceding, 0))).withColumn("_after", after)
    joined = lambda order: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n")
    pieces = told.groupBy("run_id", *here, "_no").agg(F.min("first_id").alias("first_id"), F.max_by("_after", "id").alias("_open"), joined("id").alias("line"))
    pieces = pieces.withColumn("id", F.col("first_id") + F.col("_no") - 1)
    cut = (F.col("_no") == 0) | (F.col("_open") == 1)
    # What goes on over a cut: a few pieces a block; each belongs to the last record begun before it.
    begun = F.sum((F.col("_no") > 0).cast("long")).over(W.partitionBy("run_id", "file").orderBy("start", "_no").rowsBetween(W.unboundedPreceding, 0))
    over = (pieces.where(cut).withColumn("_of", begun).groupBy("run_id", "file", "_of")
            .agg(F.min("start").alias("_at"), F.min_by("id", F.col("start")).alias("id"), joined("start").alias("line")))
    return pieces.where(~cut).select("run_id", *here, "id", "line").unionByName(
        over.select("run_id", "file", F.col("_at").alias("start"), "id", "line"))


def read_runs(spark: SparkSession, paths, comment: str = "#", normalize: bool = True, name: str | None = None, **meta) -> RunSet:
    """Load run files; files in one ``run_id=`` folder are parts of one run, in path order.

    A file's first line that is no comment is its header if its first cell is no number, else the file goes
    on under the header of the part before it.  Data lines are numbered densely over all parts of a
    run.  ``normalize`` turns milli-degrees into degrees; the time column is always in seconds.
    """
    lines = _lines(spark, paths)
    body = ~F.col("line").startswith(comment)
    blocks = written(_opened(_block_table(lines, comment)), "blocks")
    touched = blocks.where("touched").limit(1).count() > 0
    if touched:
        records = written(_records(lines, blocks, comment), "records")
        again = _block_table(records, comment)
        # A block in which no record begins has none, but is known.
        empty = blocks.where("touched").join(again.select("file", "start"), ["file", "start"], "left_anti").drop("inside", "touched")
        nothing = {c: F.lit(None).cast(dict(again.dtypes)[c]) for c in ("body_id", "body_line", "note")}
        empty = empty.withColumns({**nothing, "bodies": F.lit(0).cast("long"), "notes": F.array().cast("array<bigint>")})
        blocks = blocks.where("not touched").drop("inside").unionByName(again.unionByName(empty).withColumn("touched", F.lit(True)))
    in_file = W.partitionBy("run_id", "file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    opens = F.coalesce(F.sum("bodies").over(in_file), F.lit(0)) == 0
    is_head = opens & F.col("body_line").isNotNull() & F.expr("try_cast(substring_index(body_line, ',', 1) as double) is null")
    order = W.partitionBy("run_id").orderBy("file", "start")
    placed = blocks.withColumn("is_head", is_head).withColumn("data", F.col("bodies") - F.col("is_head").cast("long"))
    placed = (placed.withColumn("offset", F.coalesce(F.sum("data").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")))
              .withColumn("header", F.last(F.when(F.col("is_head"), F.col("body_line")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
              .withColumn("head_id", F.when(F.col("is_head"), F.col("body_id")))
              .withColumn("turn", F.row_number().over(order)))
    placed = written(placed.withColumns({c: _no_return(F.col(c)) for c in ("header", "note")}).drop("odd", "body_line", "body_id"), "placed")
    headers = split_cells(F.col("header"))

    per_run = placed.groupBy("run_id").agg(
        F.min_by("note", F.when(F.col("note").isNotNull(), F.col("turn"))).alias("comment"), F.min("file").alias("filename"), F.sum("data").alias("n_rows"))
    runs = with_name(run_metadata(per_run), name, **meta).drop("comment")
    # The columns of all parts, in the order in which they first appear.
    each = placed.where("is_head").select("run_id", "turn", F.posexplode(headers).alias("at", "raw_name"))
    first = each.groupBy("run_id", "raw_name").agg(F.min(F.struct("turn", "at")).alias("first"))
    columns = first.select("run_id", (F.row_number().over(W.partitionBy("run_id").orderBy("first")) - 1).alias("pos"), "raw_name")
    parts = F.split(F.trim("raw_name"), "/")
    columns = columns.select("run_id", "pos", "raw_name", parts[0].alias("name"),
                             F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(NO_UNIT)).alias("unit"))

    named = F.transform(headers, lambda h: F.struct(
        F.split(F.trim(h), "/")[0].alias("metric"),
        F.coalesce(F.try_element_at(F.split(F.trim(h), "/"), F.lit(2)), F.lit(NO_UNIT)).alias("unit")))
    heads = placed.select("file", "start", "touched", "first_id", "lines", "offset", "head_id", "notes", named.alias("names"))
    # The table of blocks was made by an earlier reading: if the files are cut otherwise now, fail rather than lose lines.
    same = F.coalesce((F.col("id") >= F.col("first_id")) & ((F.col("id") < F.col("first_id") + F.col("lines")) | F.col("touched")), F.lit(False))
    checked = F.when(~same, F.raise_error(F.lit("the files are cut into other blocks than before; read them again"))).otherwise(F.col("names"))
    plain = lines.where(body).join(heads, ["file", "start"], "left").withColumn("names", checked).where("touched IS NULL OR NOT touched")
    rows = plain.unionByName(records.where(body).join(heads.where("touched"), ["file", "start"])) if touched else plain
    rows = rows.where("head_id is null or id <> head_id")
    skipped = F.size(F.filter("notes", lambda n: n < F.col("id"))) + F.when(F.col("head_id") < F.col("id"), 1).otherwise(0)
    place = F.col("offset") + F.col("id") - F.col("first_id") - skipped
    rows = rows.select("run_id", place.alias("seq"), "names", split_cells(_no_return(F.col("line"))).alias("cells"))
    cells = F.filter(F.zip_with("names", "cells", lambda n, c: F.struct(n["metric"].alias("metric"), n["unit"].alias("unit"), c.alias("text"))),
                     lambda x: x["text"] != "")
    time = F.expr("try_cast(cells[0] as double)") * F.when(F.col("names")[0]["unit"] == "ms", 1e-3).otherwise(1.0)
    samples = rows.select("run_id", "seq", time.alias("t"), F.inline(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0)))))
    value = F.expr("try_cast(text as double)")
    if normalize:
        value = value * _unit_case(BASE_UNITS, 1, F.col("unit"), F.lit(1.0))
        samples = samples.withColumn("value", value).withColumn("unit", _unit_case(BASE_UNITS, 0, F.col("unit"), F.col("unit")))
    else:
        samples = samples.withColumn("value", value)
    # Text stays beside the number only where there is none.
    samples = samples.withColumn("text", F.when(F.col("value").isNull(), F.col("text")))
    return RunSet(samples.select("run_id", "seq", "t", "metric", "unit", "value", "text"), columns, runs)


def nan_to_null(samples: DataFrame) -> DataFrame:
    """Failed sensor readings are NaN in the files; treat them as missing."""
    return samples.where(~F.isnan("value") | F.col("value").isNull())


def save_runs(runs: RunSet, path: str) -> None:
    """Store as Parquet: samples split by metric, so that a query reads only its metrics.

    Ranges of (metric, run, seq) cut a hot run or metric, keep the files few and
    give narrow run ranges per row group.
    """
    order = ["metric", "run_id", "seq"]
    runs.samples.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("metric").parquet(f"{path}/samples")
    runs.columns.write.parquet(f"{path}/columns")
    runs.runs.write.parquet(f"{path}/runs")


def load_runs(spark: SparkSession, path: str) -> RunSet:
    read = spark.read
    return RunSet(read.parquet(f"{path}/samples"), read.parquet(f"{path}/columns"), read.parquet(f"{path}/runs"))


def comment_line() -> Column:
    """Comment from started_at, version and command; absent parts are left out."""
    parts = F.array(
        F.concat(F.lit("Started at: "), F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.coalesce("zone", F.lit("+0000"))),
        F.concat(F.lit("Version: "), F.col("version")), F.concat(F.lit("Generated by: "), F.col("command")))
    return F.concat(F.lit("# "), F.array_join(F.filter(parts, lambda p: p.isNotNull()), ", "))


def run_lines(samples: DataFrame, columns: DataFrame, runs: DataFrame, block_rows: int = BLOCK_ROWS,
              compact: bool = False, drop_unlisted: bool = False) -> DataFrame:
    """All lines of all files: (run_id, part, seq, value) with seq -2 for the comment and -1 for the header.

    ``columns(run_id, pos, raw_name, metric)`` gives the order after the time
    column; ``runs`` the comment facts.  ``compact`` writes six significant
    digits, as a live collector does, else numbers keep full precision.  A sample whose
    metric has no column fails the write, unless ``drop_unlisted`` leaves its cell out.
    """
    number = general_format if compact else (lambda c: c.cast("string"))
    order = F.array_sort(F.collect_list(F.struct("pos", "raw_name", "metric")))
    heads = columns.groupBy("run_id").agg(order.alias("cols"))
    cell = F.coalesce(F.col("text"), number(F.col("value")))
    lines = (samples.groupBy("run_id", "seq").agg(
        F.min("t").alias("t"), F.map_from_entries(F.collect_list(F.struct("metric", cell.alias("cell")))).alias("cells")))
    sized = meet(samples.groupBy("run_id").agg(last_seq()), heads, ["run_id"])
    lines = attach(lines, sized, ["run_id"], block_rows=block_rows)
    texts = F.transform("cols", lambda c: F.coalesce(csv_cell(F.try_element_at("cells", c["metric"])), F.lit("")))
    unknown = F.array_except(F.map_keys("cells"), F.transform("cols", lambda c: c["metric"]))
    texts = texts if drop_unlisted else F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("no column for metric "), unknown[0]))).otherwise(texts)
    time = number(F.col("t") * 1000)
    data = lines.select("run_id", block_of("seq", block_rows).alias("part"), "seq",
                        F.array_join(F.concat(F.array(time), texts), ",").alias("value"))
    zero = F.lit(0).cast("long")
    names = F.array_join(F.concat(F.array(F.lit("time/ms")), F.transform("cols", lambda c: csv_cell(c["raw_name"]))), ",")
    header = heads.select("run_id", zero.alias("part"), F.lit(-1).cast("long").alias("seq"), names.alias("value"))
    notes = runs.select("run_id", zero.alias("part"), F.lit(-2).cast("long").alias("seq"), comment_line().alias("value"))
    return data.unionByName(header).unionByName(notes)


def _folder(run: str | None, part: str) -> str:
    """The folder of a file, named as Spark names the folders of partitions."""
    name = IN_FOLDER.sub(lambda m: f"%{ord(m[0]):02X}", run) if run else NO_NAME
    return f"run_id={name}/part={part}"


def _write_files(batches: Iterator[pa.RecordBatch], top: str) -> Iterator[pa.RecordBatch]:
    """Writes sorted (run, part, value) as files below ``top``, each under a hidden name until it is whole; their number."""
    here, out, files = None, None, 0

    def close() -> None:
        out.close()
        os.replace(out.name, f"{os.path.dirname(out.name)}/part-00000.txt")

    for batch in batches:
        for run, part, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if out is None or (run, part) != here:
                if out is not None:
                    close()
                here, files = (run, part), files + 1
                folder = f"{top}/{_folder(run, part)}"
                os.makedirs(folder, exist_ok=True)
                out = open(f"{folder}/_{uuid.uuid4().hex}", "wb")
            out.write((value or "").encode() + b"\n")
    if out is not None:
        close()
    yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})


def _local_path(spark: SparkSession, path: str) -> str | None:
    """The path on the (shared) disk, if that is where Spark's path leads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def write_runs(samples: DataFrame, columns: DataFrame, runs: DataFrame, path: str, block_rows: int = BLOCK_ROWS,
               mode: str = "errorifexists", compact: bool = False, drop_unlisted: bool = False) -> None:
    """One folder per run; a run is one file unless it has more than ``block_rows`` rows, then one per part.

    There may be hundreds of thousands of small files, so the number of tasks is fixed, not merged by bytes.  For each folder and file on a disk
    Hadoop's writer starts processes that set permissions; there the tasks write the files themselves, into a
    hidden folder that gets its name when all are whole.
    """
    lines = run_lines(samples, columns, runs, block_rows, compact, drop_unlisted).withColumn("part", F.format_string("%08d", "part"))
    spark = lines.sparkSession
    laid = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "run_id", "part").sortWithinPartitions("run_id", "part", "seq")
    local = _local_path(spark, path)
    if local is None or mode not in ("error", "errorifexists", "overwrite") or (mode != "overwrite" and os.path.exists(local)):
        laid.select("value", "run_id", "part").write.mode(mode).partitionBy("run_id", "part").text(path)
        return
    top = f"{os.path.dirname(local)}/.{os.path.basename(local)}.{uuid.uuid4().hex}"
    os.makedirs(top)
    try:
        laid.select(F.col("run_id").cast("string"), "part", "value").mapInArrow(partial(_write_files, top=top), "files long").agg(F.sum("files")).collect()
        if mode == "overwrite":
            delete(spark, [f"file://{local}"])
        os.rename(top, local)
    except BaseException:
        delete(spark, [f"file://{top}"])
        raise


def read_runs_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Rows of run files as they appear: (file, seq, t, metric, value, text), each file under its own header.

    A live collector's file is read whole, as one row, so it has to fit into one (2 GB); so files that
    appear later need no table of headers made beforehand, and line breaks inside quotes are kept.
    Files in folders below ``path`` are read too.
    """
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    records = F.regexp_extract_all("value", F.lit(RECORD), F.lit(0))
    body = F.filter(records, lambda r: ~r.startswith("#") & (F.trim(r) != ""))
    files = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), body.alias("body"))
    names = F.transform(split_cells(F.col("body")[0]), lambda h: F.split(F.trim(h), "/")[0])
    rows = files.where(F.size("body") > 1).select("file", names.alias("names"), F.posexplode(F.slice("body", 2, F.size("body") - 1)).alias("seq", "line"))
    rows = rows.select("file", "names", F.col("seq").cast("long").alias("seq"), split_cells(F.regexp_replace("line", "\r$", "")).alias("cells"))
    rows = rows.withColumn("t", F.expr("try_cast(cells[0] as double) / 1000"))
    cells = F.filter(F.zip_with("names", "cells", lambda n, c: F.struct(n.alias("metric"), c.alias("text"))), lambda x: x["text"] != "")
    each = rows.select("file", "seq", "t", F.inline(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0)))))
    return each.select("file", "seq", "t", "metric", F.expr("try_cast(text as double)").alias("value"), "text")
