"""Repeated passages of words, found by fixed blocks.

A passage repeats if a window of ``WINDOW`` words occurs more than once.  Every document is cut
into non-overlapping blocks of ``BLOCK`` words; as a window has at least 2 * BLOCK - 1 words,
each holds a whole block of its own document.  So if a window occurs twice, one of
its blocks is met again at the same distance into the other occurrence.

1. *Index and probe.*  The hashes of the blocks are the index; the hash of every run of ``BLOCK`` words, at every place,
   probes it.  A run is a hit if it equals a block of any document and occurs more than once.
2. *Extend.*  Hits are extended to both sides to the windows that hold them.  The windows are compared by 96 bits
   of hashes; the first occurrence of each (smallest document, then smallest place) stays, all others are repeats.
3. *Maximal repeats.*  Repeats that overlap are one span of words, and the spans go.

How it is spread.  Documents are laid out by id in chunks of bounded size, in a bucketed table, so that chunks meet the answers to
their questions without moving texts again.  A chunk asks about its distinct hashes only, sorted and packed, in ranges
of the hash; so a hash that holds a third of all places comes once from each chunk, and a range's size does not depend on how often its
hashes occur.  The answer is one bit per hash.  Chunks are numbered in the order of ids, so the first chunk
that has a window has its first occurrence.

Defined cases: null and empty texts have no words.  A document of fewer words than a window keeps them all.  A null id
comes before all others.  Rows with one id are documents of their own, ordered by a hash of the text.
Equal rows are repeats of each other.  Very long texts are chunks of their own.  An empty table
gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import scratch_path, written
from .common import CHUNK_BYTES
from .words import mixed

WINDOW, BLOCK = 20, 10
#: A range of hashes holds about as many as so many bytes of text have words.
RANGE_BYTES = 12 << 20
#: A bucket of the chunk table holds about so many bytes of text.
BUCKET_BYTES = 64 << 20
_SLICE = 1 << 20  # bytes hashed at once

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SALTS = (np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

ASKED = "bucket int, chunk long, n int, keys binary, more binary, block binary, again binary"
ANSWER = "chunk long, step int, bucket int, n int, bits binary"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int) -> np.ndarray:
    """A 64-bit hash of each ``values[start:end]``, by running sums of powers of an odd base."""
    base = _BASES[lane]
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values))[:len(values)], dtype=np.uint64, out=sums[1:])
    back = _powers(pow(base, -1, 1 << 64), len(values))
    return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _SALTS[lane])


class Chunk:
    """The words of a chunk's documents as two lanes of hashes, with their runs and windows."""

    def __init__(self, texts: pa.Array, window: int = WINDOW, block: int = BLOCK):
        self.window, self.block = window, block
        texts = pa.compute.fill_null(texts, "").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2] if len(texts) else None
        raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        word = ~_SPACE[raw]
        before, after = np.append(False, word[:-1])[:len(raw)], np.append(word[1:], False)[:len(raw)]
        filled = np.flatnonzero(np.diff(offsets) > 0)
        before[offsets[filled]] = False
        after[offsets[filled + 1] - 1] = False
        starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        self.doc = (np.searchsorted(offsets, starts, side="right") - 1).astype(np.int64)
        self.counts = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.lanes = [np.empty(len(starts), np.uint64) for _ in _BASES]
        at = 0
        while at < len(starts):  # in slices of whole words, so that memory does not follow the longest text
            end = max(at + 1, int(np.searchsorted(ends, starts[at] + _SLICE, side="right")))
            part = raw[starts[at]:ends[end - 1]].astype(np.uint64) + np.uint64(1)
            for lane, out in enumerate(self.lanes):
                out[at:end] = run_hashes(mixed(part * _SALTS[lane]), starts[at:end] - starts[at], ends[at:end] - starts[at], lane)
            at = end

    def _runs(self, length: int, lane: int) -> np.ndarray:
        """Hashes of the runs at all places; a run that leaves its document has one too."""
        n = max(0, len(self.doc) - length + 1)
        at = np.arange(n)
        return run_hashes(self.lanes[lane], at, at + length, lane)

    def _inside(self, length: int) -> np.ndarray:
        n = max(0, len(self.doc) - length + 1)
        return self.doc[:n] == self.doc[length - 1:] if n else np.zeros(0, bool)

    def probes(self, bits: int) -> dict:
        """Distinct hashes of the runs of documents that have a window, and which of them are blocks or occur again in the chunk."""
        at = np.flatnonzero(self._inside(self.block) & (self.counts[self.doc] >= self.window)[:max(0, len(self.doc) - self.block + 1)])
        full = self._runs(self.block, 0)[at]
        order = np.argsort(full)
        keys = full[order] >> np.uint64(64 - bits)
        new = np.append(True, keys[1:] != keys[:-1])[:len(keys)]
        heads = np.flatnonzero(new)
        blocks = (at - self.first[self.doc[at]]) % self.block == 0
        times = np.diff(np.append(heads, len(keys)))
        self.probe_at, self.probe_of = at, np.empty(len(at), np.int64)
        self.probe_of[order] = np.cumsum(new) - 1
        return {"keys": keys[heads] << np.uint64(64 - bits), "more": None, "again": times > 1,
                "block": np.logical_or.reduceat(blocks[order], heads) if len(heads) else np.zeros(0, bool)}

    def windows(self, hits: np.ndarray) -> dict:
        """Distinct hashes of the windows that hold a hit; ``hits`` tells of each distinct run whether it is one."""
        hit = np.zeros(len(self.doc) + 1, np.int64)
        hit[self.probe_at[hits[self.probe_of]] + 1] = 1
        hit = np.cumsum(hit)
        inside = self._inside(self.window)
        n = len(inside)
        at = np.flatnonzero(inside & (hit[self.window - self.block + 1:][:n] > hit[:n]))
        one, two = self._runs(self.window, 0)[at], self._runs(self.window, 1)[at] >> np.uint64(32)
        order = ordered(one, two)
        one, two = one[order], two[order]
        new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[:len(one)]
        heads = np.flatnonzero(new)
        self.window_at, self.window_of = at, np.empty(len(at), np.int64)
        self.window_of[order] = np.cumsum(new) - 1
        self.window_head = np.zeros(len(at), bool)
        self.window_head[order[heads]] = True  # the order is stable, so this is the first place in the chunk
        return {"keys": one[heads], "more": two[heads].astype(np.uint32), "again": None, "block": None}

    def covered(self, first_here: np.ndarray) -> np.ndarray:
        """Words in windows that have an earlier occurrence; ``first_here``: the distinct windows first met in this chunk."""
        repeats = self.window_at[~(self.window_head & first_here[self.window_of])]
        change = np.zeros(len(self.doc) + 1, np.int64)
        np.add.at(change, repeats, 1)
        np.add.at(change, repeats + self.window, -1)
        return np.cumsum(change)[:-1] > 0


def ordered(keys: np.ndarray, more: np.ndarray) -> np.ndarray:
    """A stable order by (key, more); the second decides almost never."""
    order = np.argsort(keys, kind="stable")
    k, m = keys[order], more[order]
    return np.lexsort((more, keys)) if ((k[1:] == k[:-1]) & (m[1:] != m[:-1])).any() else order


def packed(keys: np.ndarray) -> bytes:
    """Sorted numbers as compressed planes of the bytes of their differences."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return pa.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(planes.reshape(8, n).T.copy().view("<u8").ravel(), dtype=np.uint64)


def _flags(of: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(of, np.uint8), count=n).astype(bool)


def questions(chunk: int, asked: dict, ranges: int) -> pa.Table:
    keys = asked["keys"]
    place = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    buckets, starts = np.unique(place, return_index=True)
    ends = np.append(starts[1:], len(keys))
    cut = lambda name, pack: [None if asked[name] is None else pack(asked[name][a:b]) for a, b in zip(starts, ends)]
    bits = lambda x: np.packbits(x).tobytes()
    return pa.table({
        "bucket": pa.array(buckets.astype(np.int32)), "chunk": pa.array(np.full(len(buckets), chunk, np.int64)), "n": pa.array((ends - starts).astype(np.int32)),
        "keys": pa.array(cut("keys", packed), pa.binary()), "more": pa.array(cut("more", lambda x: x.astype("<u4").tobytes()), pa.binary()),
        "block": pa.array(cut("block", bits), pa.binary()), "again": pa.array(cut("again", bits), pa.binary())})


def _answers(rows: pa.Table, step: int, judged) -> pa.Table:
    rows = rows.sort_by("chunk")
    n = rows.column("n").to_numpy()
    keys = np.concatenate([unpacked(k.as_py(), int(m)) for k, m in zip(rows.column("keys"), n)])
    parts = np.split(judged(rows, n, keys), np.cumsum(n)[:-1])
    return pa.table({"chunk": rows.column("chunk"), "step": pa.array(np.full(len(n), step, np.int32)), "bucket": rows.column("bucket"), "n": rows.column("n"),
                     "bits": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())})


def _hits(rows: pa.Table, n: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Runs that are a block somewhere and occur in several chunks, or several times in one."""
    flags = {c: np.concatenate([_flags(f.as_py(), int(m)) for f, m in zip(rows.column(c), n)]) for c in ("block", "again")}
    order = np.argsort(keys, kind="stable")
    heads = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
    times = np.diff(np.append(heads, len(keys)))
    hit = np.logical_or.reduceat(flags["block"][order], heads) & ((times > 1) | np.logical_or.reduceat(flags["again"][order], heads))
    out = np.empty(len(keys), bool)
    out[order] = np.repeat(hit, times)
    return out


def _firsts(rows: pa.Table, n: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Windows whose first chunk this is; the rows are in the order of chunks."""
    more = np.concatenate([np.frombuffer(m.as_py(), "<u4") for m in rows.column("more")])
    order = ordered(keys, more)
    k, m = keys[order], more[order]
    out = np.empty(len(keys), bool)
    out[order] = np.append(True, (k[1:] != k[:-1]) | (m[1:] != m[:-1]))
    return out


def _told(answers: pa.Table, step: int) -> np.ndarray:
    """The answers of a step in the order of the chunk's keys."""
    rows = answers.filter(pa.compute.equal(answers.column("step"), step)).sort_by("bucket")
    parts = [_flags(b.as_py(), n) for b, n in zip(rows.column("bits"), rows.column("n").to_pylist())]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def chunked(docs: DataFrame) -> tuple[str, int, int]:
    """Writes the chunk table; its name, its bytes of text, and its number of buckets."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, place = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0), np.int64).tolist()
            chunks = []
            for size in sizes:
                if held and held + size > CHUNK_BYTES:
                    chunk, held = chunk + 1, 0
                held += size
                chunks.append(chunk)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(chunks, pa.int64()), "place": pa.array(range(place, place + len(chunks)), pa.int64()),
                                              "doc_id": batch.column("doc_id"), "text": batch.column("text")})
            place += len(chunks)

    order = ["doc_id", "_h"]
    laid = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"))
            .repartitionByRange(parts, *order).sortWithinPartitions(*order))
    numbered = laid.select("doc_id", "text").mapInArrow(number, "chunk long, place long, doc_id long, text string")
    name = f"chunks_{uuid.uuid4().hex}"
    (numbered.write.bucketBy(parts, "chunk").sortBy("chunk").option("path", scratch_path(spark, "chunks"))
     .option("compression", "zstd").saveAsTable(name))
    return name, total, parts


def _opened(table: pa.Table, window: int, block: int) -> tuple[pa.Table, Chunk]:
    table = table.sort_by("place")
    return table, Chunk(table.column("text").combine_chunks(), window, block)


def without_repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, texts: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, spans, kept_sha256`` of every row, and with ``texts`` the kept words as ``kept``.

    ``spans`` are the removed [start, end) places of words.  Kept words are joined by one space.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it starts")
    spark = docs.sparkSession
    name, total, parts = chunked(docs)
    ranges = max(64, total // RANGE_BYTES)
    bits = min(60, max(32, total.bit_length() + 6))  # a run without partner equals a block by chance once in some thousand
    table = spark.table(name)

    def probe(key, rows: pa.Table) -> pa.Table:
        _, chunk = _opened(rows, window, block)
        return questions(key[0].as_py(), chunk.probes(bits), ranges)

    asked = table.groupBy("chunk").applyInArrow(lambda key, rows: probe(key, rows), ASKED)
    hits = written(asked.groupBy("bucket").applyInArrow(lambda rows: _answers(rows, 1, _hits), ANSWER), "hits")

    def extend(key, rows: pa.Table, answers: pa.Table) -> pa.Table:
        _, chunk = _opened(rows, window, block)
        chunk.probes(bits)
        return questions(key[0].as_py(), chunk.windows(_told(answers, 1)), ranges)

    def met(answers: DataFrame, act, schema: str) -> DataFrame:
        to = answers.repartition(parts, "chunk").groupBy("chunk")
        return table.groupBy("chunk").cogroup(to).applyInArrow(lambda key, left, right: act(key, left, right), schema)

    asked = met(hits, extend, ASKED)
    firsts = written(asked.groupBy("bucket").applyInArrow(lambda rows: _answers(rows, 2, _firsts), ANSWER), "firsts")

    def cut(key, rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows, chunk = _opened(rows, window, block)
        chunk.probes(bits)
        chunk.windows(_told(answers, 1))
        gone = chunk.covered(_told(answers, 2))
        change = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        at = chunk.doc[np.minimum(np.arange(len(gone) + 1), len(gone) - 1)] if len(gone) else np.zeros(1, np.int64)
        # A span ends with its document as well.
        border = np.append(False, (chunk.doc[1:] != chunk.doc[:-1]) & gone[1:] & gone[:-1])[:len(gone)]
        starts = np.flatnonzero((change[:-1] == 1) | border) if len(gone) else np.zeros(0, np.int64)
        ends = np.flatnonzero((change[1:] == -1) | np.append(border[1:], False)) + 1 if len(gone) else np.zeros(0, np.int64)
        of, spans = at[starts] if len(starts) else np.zeros(0, np.int64), [[] for _ in range(rows.num_rows)]
        for d, a, b in zip(of.tolist(), starts.tolist(), ends.tolist()):
            spans[d].append({"start": a - int(chunk.first[d]), "end": b - int(chunk.first[d])})
        kept = []
        for text, n, first, removed in zip(rows.column("text"), chunk.counts.tolist(), chunk.first.tolist(), spans):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            kept.append(b" ".join(compress(words, (~gone[first:first + n]).tolist()) if removed else words))
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), chunk.first) * (chunk.counts > 0) if len(chunk.first) else chunk.counts
        out = {"doc_id": rows.column("doc_id"), "n_words": pa.array(chunk.counts), "n_removed": pa.array(removed),
               "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
               "kept_sha256": pa.array([sha256(k).hexdigest() for k in kept])}
        return pa.table(out | ({"kept": pa.array([k.decode("utf-8", "surrogatepass") for k in kept])} if texts else {}))

    schema = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string" + (", kept string" if texts else "")
    out = written(met(hits.union(firsts), cut, schema), "cut")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return out
