"""Run files that grow: a streaming source whose offset stands for the end of the last whole record of each file.

What a trigger finds new in a file, from one record's end to another's, is cut at record starts into ranges of
bytes; a partition is one large range or many small ones, read where Spark places it.  A half-written record at the end of a file
waits for the next trigger; quoted cells may hold line breaks.  Planning reads the new bytes too, to find where records
end, in constant memory: this source is for files as live programs write them, a backlog belongs to ``read_runs``.

Files are found again by every trigger, in all folders below the path.  A file may grow, not shrink; it keeps the header it began with.

The ends of all files are a table in a folder of their own, one per trigger that finds something new (the last ``KEPT`` stay); an offset names
that table and does not grow with the files.  Planning holds a file as its name and four numbers, and hands partitions out packed.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.columns import BASE_UNITS, NO_UNIT, _unit_case
from ..plans.scratch import shared_folder
from .runfiles import CELL, LEAVES_OPEN, RUN_FOLDER

SCHEMA = "run_id string, file string, at long, time string, time_unit string, metric string, unit string, cell string"
#: Bytes of a partition, of one read while planning, and cells of an Arrow batch.
SPLIT, PIECE, BATCH = 32 << 20, 4 << 20, 50_000
#: What opening a file counts as, in bytes of a partition; files looked at together while planning.
OPENING, THREADS = 128 << 10, 16
HEAD = 64 << 10  # bytes of one read for a header
#: Files handed to the planning threads, or turned to Arrow, at once; tables of ends that stay, as many as the offsets Spark keeps.
FILES, KEPT = 10_000, 100

_CELL, _RUN = re.compile(CELL), re.compile(RUN_FOLDER)
_OPEN = re.compile(LEAVES_OPEN.encode())


def cells_of(record: str) -> list[str]:
    return [c[1:-1].replace('""', '"') if c.startswith('"') else c for c in _CELL.findall("," + record)]


class Records:
    """Cuts lines into records: whether a line ends one depends on the quotes open so far."""

    def __init__(self, comment: bytes):
        self.comment, self.inside = comment, False

    def ends(self, line: bytes) -> bool:
        """Takes the next line; whether it is the last of its record."""
        if line.count(b'"') % 2:
            self.inside = not self.inside and not line.startswith(self.comment) and bool(_OPEN.match(line.rstrip(b"\n").removesuffix(b"\r")))
        return not self.inside


def records(pieces: Iterator[bytes], at: int, comment: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, bytes) of the whole records of a stretch of a file that begins at a record's start."""
    cut, held, start, rest = Records(comment), [], at, b""
    for piece in pieces:
        lines = (rest + piece).split(b"\n")
        rest = lines.pop()
        for line in lines:
            at += len(line) + 1
            if cut.ends(line):
                yield start, at, b"\n".join([*held, line])
                held, start = [], at
            else:
                held.append(line)


def whole_records(pieces: Iterator[bytes], at: int, comment: bytes, split: int, most: int | None) -> tuple[int, list[int]]:
    """As told by ``records``: the end of the last record (the first one that reaches ``most`` bytes, if any does), and starts at least ``split`` apart.

    Only lines with an odd number of quotes are looked at one by one.
    """
    cut, end, cuts, first, rest = Records(comment), at, [at], at, b""
    for piece in pieces:
        text = rest + piece
        raw = np.frombuffer(text, np.uint8)
        breaks = np.flatnonzero(raw == 10)
        rest = text[int(breaks[-1]) + 1:] if len(breaks) else text
        if not len(breaks):
            continue
        ends = np.full(len(breaks), not cut.inside)
        if b'"' in text:
            quotes = np.searchsorted(np.flatnonzero(raw == 34), breaks)
            begin = 0
            for i in np.flatnonzero(np.diff(quotes, prepend=0) % 2):
                ends[begin:i] = not cut.inside
                ends[i] = cut.ends(text[int(breaks[i - 1]) + 1 if i else 0:int(breaks[i])])
                begin = i + 1
            ends[begin:] = not cut.inside
        stops = at + breaks[ends] + 1
        if most is not None and len(stops) and stops[-1] - first >= most:
            stops = stops[:np.searchsorted(stops, first + most) + 1]
        # A record starts where the one before it ends.
        starts = np.append(end, stops[:-1])
        i = np.searchsorted(starts, cuts[-1] + split)
        while i < len(starts) and len(stops):
            cuts.append(int(starts[i]))
            i = np.searchsorted(starts, cuts[-1] + split)
        if len(stops):
            end = int(stops[-1])
            if most is not None and end - first >= most:
                break
        at += int(breaks[-1]) + 1
    return end, cuts


class Stretch(NamedTuple):
    """Whole records of a file, from byte ``start`` to byte ``end``; its own header, if any, is at ``header_at``."""

    file: str
    run_id: str
    header: list[str]
    header_at: int
    start: int
    end: int


class Stretches(InputPartition):
    """Stretches, compressed: the driver holds those of all new files at once."""

    def __init__(self, parts: list[Stretch]):
        super().__init__(parts[0].file)
        self.packed = zlib.compress(pickle.dumps([tuple(p) for p in parts]))

    @property
    def parts(self) -> list[Stretch]:
        return [Stretch(*p) for p in pickle.loads(zlib.decompress(self.packed))]


def packed(parts: Iterable[Stretch], split: int) -> list[Stretches]:
    """Stretches in their order, about ``split`` bytes to a partition."""
    out, held, size = [], [], 0
    for part in parts:
        if held and size + part.end - part.start > split:
            out.append(Stretches(held))
            held, size = [], 0
        held.append(part)
        size += part.end - part.start + OPENING
    return [*out, Stretches(held)] if held else out


def _places(files: pa.Array, among: pa.Array) -> np.ndarray:
    """Where each file is among others; -1: nowhere."""
    return pc.fill_null(pc.index_in(files, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _names(files: list[str]) -> pa.Array:
    return pa.array(files, pa.large_string())


class RunTailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.comment = options.get("comment", "#").encode()
        self.split = int(options.get("split", SPLIT))
        self.most = int(options["maxbytespertrigger"]) if "maxbytespertrigger" in options else None
        self.state = options.get("state")
        # Of every file found so far, by name: its size, how far it was taken, its header (None: not known) and where that is, and the part before it in its folder.
        self.files, self.sizes, self.ends, self.header_at, self.before = _names([]), *(np.zeros(0, np.int64) for _ in range(4))
        self.heads = np.full(0, None)
        self.headers: dict[tuple[str, ...], list[str]] = {}  # files of equal headers share one
        self.cuts: dict[tuple[str, int], list[int]] = {}
        self.saved: tuple[dict, pa.Array, np.ndarray] = {}, _names([]), np.zeros(0, np.int64)
        self.tables: list[str] = []

    def _store(self) -> tuple[pafs.FileSystem, str]:
        return self._at(self.path)

    @staticmethod
    def _at(path: str) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)

    def _pieces(self, store: pafs.FileSystem, file: str, start: int, end: int | None = None, piece_bytes: int = PIECE) -> Iterator[bytes]:
        with store.open_input_file(file) as f:
            f.seek(start)
            while (n := piece_bytes if end is None else min(piece_bytes, end - start)) and (piece := f.read(n)):
                start += len(piece)
                yield piece

    @staticmethod
    def _found(store: pafs.FileSystem, path: str) -> Iterator[tuple[str, int]]:
        """Names and sizes of the files, folder by folder."""
        if isinstance(store, pafs.LocalFileSystem):
            with suppress(FileNotFoundError), os.scandir(path) as entries:
                for e in entries:
                    with suppress(FileNotFoundError):  # gone meanwhile
                        if e.is_dir():
                            yield from RunTailReader._found(store, e.path)
                        elif e.is_file() and not e.name.startswith(("_", ".")):
                            yield e.path, e.stat().st_size
            return
        for f in store.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
            if f.type == pafs.FileType.Directory:
                yield from RunTailReader._found(store, f.path)
            elif f.is_file and not f.base_name.startswith(("_", ".")):
                yield f.path, f.size

    def _look(self, more: pa.Array | None = None) -> pafs.FileSystem:
        """Lists the files; what is known of them stays, and so do known files that are not there."""
        store, path = self._store()
        names, sizes, some, bytes_ = [], [], [], []
        for name, size in self._found(store, path if path == "/" else path.rstrip("/")):
            some.append(name)
            bytes_.append(size)
            if len(some) >= FILES:
                names, sizes, some, bytes_ = [*names, _names(some)], [*sizes, np.array(bytes_, np.int64)], [], []
        files, size = pa.concat_arrays([*names, _names(some)]), np.concatenate([*sizes, np.array(bytes_, np.int64)])
        there = len(files)
        for known in (self.files, more):
            if known is not None and len(known):
                gone = known.filter(pc.equal(pa.array(_places(known, files)), -1))
                files, size = pa.concat_arrays([files, gone]), np.append(size, np.zeros(len(gone), np.int64))
        order = pc.sort_indices(files).to_numpy()
        files, size, there = files.take(pa.array(order)), size[order], (order < there)
        at = _places(files, self.files)
        old = lambda column, none: np.where(at >= 0, column[at], none) if len(column) else np.full(len(files), none)
        self.ends, self.heads, self.header_at = old(self.ends, 0), old(self.heads, None), old(self.header_at, -1)
        self.files, self.sizes = files, size
        # Of each file that is there the one before it in its folder.
        folder = pc.replace_substring_regex(files, "/[^/]*$", "").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        here = np.flatnonzero(there)
        by_folder = here[np.argsort(folder[here], kind="stable")]
        self.before = np.full(len(files), -1)
        same = folder[by_folder[1:]] == folder[by_folder[:-1]]
        self.before[by_folder[1:][same]] = by_folder[:-1][same]
        return store

    def _header(self, store: pafs.FileSystem, row: int) -> bool:
        """Notes the file's own header and its place, else that of the part before it in its folder; false while it has no whole first record."""
        if self.heads[row] is None:
            first = next(((at, r) for at, _, r in records(self._pieces(store, self.files[row].as_py(), 0, piece_bytes=HEAD), 0, self.comment) if not r.startswith(self.comment)), None)
            if first is None:
                return False
            cells = cells_of(first[1].decode("utf-8", "replace").removesuffix("\r"))
            before = self.before[row]
            try:
                float(cells[0])
            except ValueError:
                self.header_at[row], self.heads[row] = first[0], self.headers.setdefault(tuple(cells), cells)
            else:
                if before >= 0 and not self._header(store, before):
                    return False  # the part before has not come so far
                self.heads[row] = self.heads[before] if before >= 0 else []
        return True

    def _whole(self, store: pafs.FileSystem, file: str, start: int, size: int, most: int | None) -> int:
        """The end of the last whole record between ``start`` and ``size``; notes where partitions may be cut on the way."""
        end, cuts = whole_records(self._pieces(store, file, start, size), start, self.comment, self.split, most)
        if len(cuts) > 1:
            self.cuts[file, start] = cuts
        return end

    def _offset(self) -> dict:
        """Names a table of the ends, a new one if they are not those of the last."""
        some = np.flatnonzero(self.ends)
        files, ends = self.files.take(pa.array(some)), self.ends[some]
        if not np.array_equal(ends, self.saved[2]) or not files.equals(self.saved[1]):
            if self.state is None:
                self.state = tempfile.mkdtemp(prefix="run-")
            path = f"{self.state}/{uuid.uuid4().hex}.arrow"
            store, where = self._at(path)
            store.create_dir(where.rpartition("/")[0], recursive=True)
            table = pa.table({"file": files, "end": ends})
            with store.open_output_stream(where) as out, pa.ipc.new_file(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table)
            self.saved = {"state": path, "files": len(files), "bytes": int(ends.sum())}, files, ends
            self.tables.append(path)
        return self.saved[0]

    def _ends_of(self, offset: dict) -> tuple[pa.Array, np.ndarray]:
        if offset == self.saved[0]:
            return self.saved[1:]
        if not isinstance(offset.get("state"), str):  # nothing, or an offset that names every file
            return _names(sorted(offset)), np.array([offset[f] for f in sorted(offset)], np.int64)
        store, where = self._at(offset["state"])
        with store.open_input_file(where) as f:
            table = pa.ipc.open_file(f).read_all().combine_chunks()
        return pa.concat_arrays([_names([]), *table.column("file").chunks]), table.column("end").to_numpy()

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store = self._look()
        news = np.flatnonzero(self.sizes > self.ends)
        most = None if self.most is None else max(1, self.most // max(1, len(news)))

        def end(row: int) -> int | None:
            if not self._header(store, row):
                return None
            return self._whole(store, self.files[row].as_py(), int(self.ends[row]), int(self.sizes[row]), most)

        with ThreadPoolExecutor(THREADS) as pool:
            for some in (news[a:a + FILES].tolist() for a in range(0, len(news), FILES)):
                for row, to in zip(some, pool.map(end, some)):
                    if to is not None:
                        self.ends[row] = to
        return self._offset()

    def partitions(self, start: dict, end: dict) -> list[Stretches]:
        store, _ = self._store()
        (files, to), (before, begun) = self._ends_of(end), self._ends_of(start)
        at, was = _places(files, self.files), _places(files, before)
        if (at < 0).any():  # after a restart
            store = self._look(files)
            at = _places(files, self.files)
        begin = np.where(was >= 0, begun[was], 0) if len(begun) else np.zeros(len(files), np.int64)
        self.ends[at] = np.maximum(self.ends[at], to)

        def stretches() -> Iterator[Stretch]:
            for i in np.flatnonzero(to > begin).tolist():
                file, row, a, b = files[i].as_py(), int(at[i]), int(begin[i]), int(to[i])
                if not self._header(store, row) or not self.heads[row]:
                    continue
                if b - a > self.split and (file, a) not in self.cuts:
                    self._whole(store, file, a, b, None)
                cuts = [c for c in self.cuts.get((file, a), [a]) if c < b]
                run = _RUN.search(file)
                for c, d in zip(cuts, [*cuts[1:], b]):
                    yield Stretch(file, run.group(1) if run else file, self.heads[row], int(self.header_at[row]), c, d)

        return packed(stretches(), self.split)

    def commit(self, end: dict) -> None:
        if self.cuts:
            files, to = self._ends_of(end)
            at = _places(_names([f for f, _ in self.cuts]), files)
            self.cuts = {(f, a): c for i, ((f, a), c) in zip(at, self.cuts.items()) if i < 0 or a >= to[i]}
        while len(self.tables) > KEPT:
            store, where = self._at(self.tables.pop(0))
            with suppress(FileNotFoundError):
                store.delete_file(where)

    def read(self, part: Stretches) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()
        columns: list[list] = [[] for _ in SCHEMA.split(", ")]

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 2 else pa.string()) for i, c in enumerate(columns)],
                                              names=[x.split()[0] for x in SCHEMA.split(", ")])
            for c in columns:
                c.clear()
            return made

        for one in part.parts:
            names = [h.strip().split("/") for h in one.header]
            names = [(n[0], n[1] if len(n) > 1 else NO_UNIT) for n in names]
            for at, _, record in records(self._pieces(store, one.file, one.start, one.end), one.start, self.comment):
                if record.startswith(self.comment) or at == one.header_at:
                    continue
                cells = cells_of(record.decode("utf-8", "replace").removesuffix("\r"))
                for (name, unit), cell in zip(names[1:], cells[1:]):
                    if cell != "":
                        for column, value in zip(columns, (one.run_id, one.file, at, cells[0], names[0][1], name, unit, cell)):
                            column.append(value)
                if len(columns[0]) >= BATCH:
                    yield batch()
        if columns[0]:
            yield batch()

    def stop(self) -> None:
        pass


class RunTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "run_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> RunTailReader:
        return RunTailReader({k.lower(): v for k, v in self.options.items()})


def follow_runs(spark: SparkSession, path: str, max_bytes: int | None = None, split: int = SPLIT, comment: str = "#", normalize: bool = True,
                state: str | None = None) -> DataFrame:
    """Samples of run files as they are appended: (run_id, file, at, t, metric, unit, value, text).

    ``at`` is the byte at which a sample's record begins, so it orders the records of a file.  ``max_bytes`` bounds what a trigger takes, about
    evenly over the files that grew; a trigger always takes whole records, one per such file at least.  With ``availableNow``, which is a
    single trigger here, leave it out.  ``state`` is the folder for the ends of the files: give one that lives as long as the query's checkpoint
    (default: one in the shared folder, which ``scratch.clear`` does not touch).
    """
    spark.dataSource.register(RunTail)
    state = state or f"{shared_folder(spark)}/followed-{hashlib.md5(path.encode()).hexdigest()}"
    reader = spark.readStream.format("run_tail").option("path", path).option("split", split).option("comment", comment).option("state", state)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    rows = reader.load()
    time = F.expr("try_cast(time as double)") * F.when(F.col("time_unit") == "ms", 1e-3).otherwise(1.0)
    value = F.expr("try_cast(cell as double)")
    unit = F.col("unit")
    if normalize:
        value, unit = value * _unit_case(BASE_UNITS, 1, F.col("unit"), F.lit(1.0)), _unit_case(BASE_UNITS, 0, F.col("unit"), F.col("unit"))
    return rows.select("run_id", "file", "at", time.alias("t"), "metric", unit.alias("unit"), value.alias("value"),
                       F.when(value.isNull(), F.col("cell")).alias("text"))
