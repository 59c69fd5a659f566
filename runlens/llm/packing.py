"""Bounded-space online packing of token sequences.

Every partition keeps a fixed number of open windows.  A document's full windows
leave at once; its rest goes to the open window with the smallest gap that
still holds it.  If none does, the fullest window is emitted and a new one opened.
Windows still open at the end of a partition are leftovers: their pieces are
packed again in ever fewer partitions, ``FAN_IN`` partitions' leftovers at a time,
so that no task ever sees more than ``FAN_IN * OPEN`` windows.

Defined cases: a null or empty text is the end token alone.  Repeated rows are packed
each for itself.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written

WINDOW = 2048
OPEN = 64
FAN_IN = 16
END = 1
CACHED_WORDS = 500_000

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Letters whose normal form is their lower case.
_PLAIN = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_MARKS = b".,;:!?"
#: How the tokenizer writes the bytes of Latin-1 letters: printable bytes as themselves, the others from 256 on.
_ODD = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_BYTE = {b: chr(256 + _ODD.index(b)) if b in _ODD else chr(b) for b in range(256)}


class Words(dict):
    """Token ids of words (UTF-8), with two bounded generations of words seen before.

    The tokenizer drops white space and never joins across it, so a text's ids are its
    words' ids in order.  It splits letters from marks too, so a plain word with marks behind it is
    the word's ids and the marks'.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        self.older: dict[bytes, bytes] = {}

    def ids(self, text: bytes) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        if len(self) > CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        # ``split`` of bytes cuts at ASCII white space only.
        return b"".join(map(self.__getitem__, text.split()))

    def __missing__(self, word: bytes) -> bytes:
        made = self[word] = self.older.get(word) or self.learn(word)
        return made

    def learn(self, word: bytes) -> bytes:
        core = word.rstrip(_MARKS)
        if core.isalpha():  # ASCII letters
            low = core.lower()
            spelled = low.decode()
        elif _PLAIN.fullmatch(text := core.decode()):
            low = text.lower().encode()
            spelled = "".join([_BYTE[b] for b in low])
        else:
            return self.encoded(word)
        made = self.get(low) or self.older.get(low)
        if not made:
            made = self[low] = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return made if len(core) == len(word) else made + self.marks(word[len(core):])

    def marks(self, run: bytes) -> bytes:
        if run not in self:
            self[run] = self.encoded(run)
        return self[run]

    def encoded(self, word: bytes) -> bytes:
        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()


_loaded: dict[int, Words] = {}


def words_of(spec: str) -> Words:
    """The tokenizer of this worker process."""
    key = crc32(spec.encode())
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Words(spec)
    return _loaded[key]


class Packer:
    """Best fit over a bounded number of open windows; rows are (piece without place)."""

    def __init__(self, first: int, window: int, open_windows: int):
        self.next, self.window, self.most = first, window, open_windows
        self.rows: list[tuple] = []
        self.fills: list[tuple[int, int]] = []  # (fill, sequence), sorted
        self.pieces: dict[int, list[tuple]] = {}

    def fresh(self) -> int:
        self.next += 1
        return self.next - 1

    def close(self, at: int) -> None:
        self.rows += self.pieces.pop(self.fills.pop(at)[1])

    def add(self, piece: tuple, length: int) -> None:
        if length >= self.window:
            self.rows.append((*piece, self.fresh(), 0))
            return
        at = bisect_left(self.fills, (self.window - length + 1, -1)) - 1  # the fullest that still holds it
        if at >= 0:
            fill, sequence = self.fills.pop(at)
        else:
            if len(self.fills) >= self.most:
                self.close(len(self.fills) - 1)
            fill, sequence = 0, self.fresh()
            self.pieces[sequence] = []
        self.pieces[sequence].append((*piece, sequence, fill))
        if fill + length == self.window:
            self.rows += self.pieces.pop(sequence)
        else:
            insort(self.fills, (fill + length, sequence))

    def leftovers(self) -> list[tuple]:
        return [row for _, sequence in self.fills for row in self.pieces[sequence]]


def _batch(rows: list[tuple], schema: pa.Schema, last: bool) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([last] * len(rows), pa.bool_())], schema=schema)


_SCHEMA = pa.schema([*((c.split()[0], pa.int64()) for c in PIECE.split(", ")), ("open", pa.bool_())])


def _emit(packer: Packer) -> Iterator[pa.RecordBatch]:
    if packer.rows:
        yield _batch(packer.rows, _SCHEMA, False)
        packer.rows = []


def first_pass(docs: DataFrame, spec: str, window: int, open_windows: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # one tokenizer file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(shared.value)
        packer = Packer(TaskContext.get().partitionId() << 32, window, open_windows)
        tail = array("I", [END]).tobytes()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = memoryview(words.ids(memoryview(text.as_buffer()).tobytes() if text.is_valid else b"") + tail)
                n = len(raw) // 4
                for start in range(0, n, window):
                    length = min(window, n - start)
                    packer.add((doc_id, start, length, crc32(raw[4 * start:4 * (start + length)]), n), length)
                if len(packer.rows) >= 5000:
                    yield from _emit(packer)
        yield from _emit(packer)
        if left := packer.leftovers():
            yield _batch(left, _SCHEMA, True)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"{PIECE}, open boolean")


def next_pass(left: DataFrame, level: int, last: bool, window: int, open_windows: int) -> DataFrame:
    """Packs leftovers again, in one group per ``FAN_IN`` partitions of the level below.

    The order mixes lengths: few windows are open, and short pieces must come while long ones leave gaps.
    """
    def run(key, rows: pa.Table) -> pa.Table:
        packer = Packer((level << 56) | (key[0].as_py() << 32), window, open_windows)
        rows = rows.sort_by([("ids_crc32", "ascending"), ("doc_id", "ascending"), ("start", "ascending"), ("sequence_id", "ascending")])
        for piece in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens"))):
            packer.add(piece, piece[2])
        rest = packer.leftovers()
        done = pa.Table.from_batches([_batch(packer.rows + (rest if last else []), _SCHEMA, False)])
        return done if last else pa.concat_tables([done, pa.Table.from_batches([_batch(rest, _SCHEMA, True)])])

    part = F.col("sequence_id").bitwiseAND(F.lit((1 << 56) - 1))
    group = F.floor(F.shiftright(part, 32) / FAN_IN).cast("long")
    return left.withColumn("_group", group).groupBy("_group").applyInArrow(
        lambda key, rows: run(key, rows), f"{PIECE}, open boolean")


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, open_windows: int = OPEN) -> DataFrame:
    """One row per piece: where it starts in its document, how long it is, and its place in a sequence.

    ``tokenizer_path`` is a file of the ``tokenizers`` library; the driver reads it.
    Each pass is stored, so a retried task can't mix two packings.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    parts = max(1, docs.rdd.getNumPartitions())
    done = written(first_pass(docs, spec, window, open_windows), "packed")
    out, level = done.where(~F.col("open")), 0
    while True:
        level, parts = level + 1, -(-parts // FAN_IN)
        done = written(next_pass(done.where("open"), level, parts == 1, window, open_windows), "packed")
        out = out.unionByName(done.where(~F.col("open")))
        if parts == 1:
            return out.drop("open")


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per sequence: filled tokens, and the length it is stored with (a power of two stays, else ``window``)."""
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("filled"), F.count("*").alias("pieces"))
    exact = F.col("filled").bitwiseAND(F.col("filled") - 1) == 0
    return filled.withColumn("padded", F.when(exact, F.col("filled")).otherwise(F.lit(window)))
