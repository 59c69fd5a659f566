"""Removal of repeated strings by sorted suffixes over a content-defined difference cover.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else.  Only the
first ``LENGTH`` bytes of a suffix matter, so the suffix order is needed to that depth.

* Cover: of all suffixes only those at anchors (``anchors.py``) are sampled.  As with a difference
  cover, two equal strings have a sampled suffix at the same distance behind their starts;
  here for equal strings only, which leaves one sample in about 64 bytes instead of two in three.
* Triples: a sample's triple is (bytes before it, its gram, bytes behind it), as far as the strings
  it stands for reach.  The triples are named by hashes, sorted, and compared with their neighbours: an
  equal neighbour means that all strings of the sample occur twice.  A triple reaches the whole depth, so
  names need no further round of triples.
* Merge: what remains are strings of samples with the same gram in different triples.  One copy of each such
  triple is sorted by gram, and the strings of a gram's triples are named, sorted and
  compared with their neighbours in turn.  A gram with more than ``GROUP`` triples sends its strings' names on to a distributed count.

Names are 64-bit hashes; both sorts compare them only among equal grams.

Defined cases: a null text is empty; a text shorter than ``LENGTH`` bytes loses nothing.  Copies of a long enough text
lose all bytes.  Repeated rows are copies.  An empty table gives an empty result.  ``keep``
names the columns to carry along; others are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.scratch import written
from .anchors import Anchors, Rolling
from .common import chunks, map_texts, whole_text
from .words import encoded, mixed

LENGTH = 200
GROUP = 1 << 14
CHUNK_BYTES = 2 << 20  # every byte takes some 90 bytes of numbers while it is handled

# What is known of a sample: all its strings repeat; some may; all repeat and it stands for its triple in the merge.
WHOLE, PART, STANDS = 1, 2, 3


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def sampled(docs: DataFrame, length: int) -> DataFrame:
    """Stored per row: its number, text digest, its samples' places, grams and triple names, and the places known to repeat.

    Equal triples of one chunk are counted before anything is shuffled: the first of them goes on for all,
    with ``twice`` set.
    """
    def make(_, texts):
        parts = [encoded(t) for t in texts]
        found = Anchors(parts, length)
        names = Rolling(found.raw).parts(found.first, found.last + length)
        names = mixed(names + (found.at - found.first).astype(np.uint64))
        starts = np.cumsum(np.bincount(found.doc, minlength=len(parts)))
        place = np.arange(len(names)) - np.concatenate([[0], starts])[found.doc] if len(names) else np.zeros(0, np.int64)
        order = np.lexsort((names, found.print))
        new = np.ones(len(order), bool)
        new[1:] = (names[order][1:] != names[order][:-1]) | (found.print[order][1:] != found.print[order][:-1])
        first = np.zeros(len(order), bool)
        first[order[new]] = True  # the sort is stable, so the earliest comes first
        twice = np.zeros(len(order), bool)
        heads = np.flatnonzero(new)
        twice[order[heads[np.diff(np.append(heads, len(order))) > 1]]] = True

        def lists(x, wanted):
            ends = np.concatenate([[0], np.cumsum(np.bincount(found.doc[wanted], minlength=len(parts)))]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(x[wanted]))

        return {"at": lists(place.astype(np.int32), first), "gram": lists(found.print.view(np.int64), first), "triple": lists(names.view(np.int64), first),
                "twice": lists(twice, first), "again": lists(place.astype(np.int32), ~first)}

    named = docs.select(whole_text().alias("text")).withColumn("digest", digest(F.col("text")))
    made = map_texts(named, make, "at array<int>, gram array<long>, triple array<long>, twice array<boolean>, again array<int>", ["digest"], CHUNK_BYTES)
    return written(made.withColumn("row", F.monotonically_increasing_id()), "samples")


def marked(samples: DataFrame) -> DataFrame:
    """(digest, marks(at, kind)) of texts with samples that repeat or may."""
    each = samples.select("row", F.inline(F.arrays_zip("at", "gram", "triple", "twice")))
    equal, gram = W.partitionBy("gram", "triple"), W.partitionBy("gram")
    compared = (each.withColumn("n", F.count("*").over(equal) + F.max(F.col("twice").cast("int")).over(equal)).withColumn("turn", F.row_number().over(equal.orderBy("row", "at")))
                .withColumn("mixed", F.min("triple").over(gram) < F.max("triple").over(gram)))
    kind = (F.when((F.col("n") > 1) & F.col("mixed") & (F.col("turn") == 1), STANDS).when(F.col("n") > 1, WHOLE).when(F.col("mixed"), PART))
    known = compared.select("row", "at", kind.cast("byte").alias("kind")).where("kind is not null")
    marks = known.groupBy("row").agg(F.collect_list(F.struct("at", "kind")).alias("marks"))  # of one text
    # The first of some copies of a text has all marks that stand for others.
    first = samples.groupBy("digest").agg(F.min("row").alias("row"))
    again = F.transform("again", lambda a: F.struct(a.alias("at"), F.lit(WHOLE).cast("byte").alias("kind")))
    none = F.array().cast("array<struct<at: int, kind: tinyint>>")
    both = (samples.select("row", again.alias("again")).join(first, "row").join(marks, "row", "left")
            .select("digest", F.concat("again", F.coalesce("marks", none)).alias("marks")).where(F.size("marks") > 0))
    return written(both, "marks")


def spans_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals that start in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > reach[:-1])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]


def cut(raw: bytes, starts: list[int], ends: list[int]) -> bytes:
    kept, at = [], 0
    for a, b in zip(starts, ends):
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return b"".join(kept)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_STRINGS = pa.list_(pa.struct([("gram", pa.int64()), ("start", pa.int64()), ("before", pa.int32()), ("bytes", pa.binary()), ("stands", pa.bool_())]))


def first_cut(docs: DataFrame, marks: DataFrame, keep: list[str], length: int) -> DataFrame:
    """Stored per row: ``keep``, text, the spans known to repeat, and the triples to merge."""
    named = docs.select(*keep, whole_text().alias("_text")).withColumn("_digest", digest(F.col("_text")))
    joined = named.join(marks.withColumnRenamed("digest", "_digest"), "_digest", "left").select(*keep, F.col("_text").alias("text"), "marks")

    def make(part: pa.RecordBatch, texts: list[str]) -> dict:
        parts = [encoded(t) for t in texts]
        found = Anchors(parts, length)
        ends = np.cumsum(np.bincount(found.doc, minlength=len(parts)))
        raw = found.raw.tobytes()
        spans, strings = [], []
        for i, marks_ in enumerate(part.column("marks").to_pylist()):
            if not marks_:
                spans.append([])
                strings.append(None)
                continue
            base, offset = int(ends[i - 1]) if i else 0, int(found.starts[i])
            at = np.array([m["at"] for m in marks_]) + base
            kind = np.array([m["kind"] for m in marks_])
            whole = at[kind != PART]
            a, b = spans_of(found.first[whole] - offset, found.last[whole] + length - offset)
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(a, b)])
            strings.append([{"gram": int(found.print[s].astype(np.int64)), "start": int(found.first[s] - offset), "before": int(found.at[s] - found.first[s]),
                             "bytes": raw[found.first[s]:found.last[s] + length], "stands": k == STANDS}
                            for s, k in zip(at, kind) if k != WHOLE] or None)
        return {"spans": pa.array(spans, _SPANS), "strings": pa.array(strings, _STRINGS)}

    made = map_texts(joined, make, "spans array<struct<start: long, end: long>>, "
                                   "strings array<struct<gram: long, start: long, before: int, bytes: binary, stands: boolean>>", [*keep, "text", "marks"], CHUNK_BYTES)
    return written(made.drop("marks").withColumn("_row", F.monotonically_increasing_id()), "first-cut", compression="zstd")


def merged(pending: DataFrame, length: int, group: int) -> DataFrame:
    """(row, spans) that the merge adds; ``pending(_row, strings)``."""
    triples = pending.select("_row", F.inline("strings"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        sending = None  # a gram whose strings go on to the distributed count
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < 2048:
                continue
            whole = pa.Table.from_batches(held)
            gram = whole.column("gram").to_numpy()
            end = int(np.searchsorted(gram, gram[-1]))  # the last gram may go on
            if end:
                yield from compared(whole.slice(0, end), sending)
                whole = whole.slice(end)
                sending = None
            if whole.num_rows > group:
                sending = int(gram[-1])
                yield from names(whole)
                whole = whole.slice(whole.num_rows)
            held, rows = whole.to_batches(), whole.num_rows
        if held:
            yield from compared(pa.Table.from_batches(held), sending)

    def compared(table: pa.Table, sending: int | None) -> Iterator[pa.RecordBatch]:
        """Resolves whole grams; the rest of a gram that is being sent on goes the same way."""
        gram = table.column("gram").to_numpy()
        if sending is not None and len(gram) and gram[0] == sending:
            end = int(np.searchsorted(gram, sending, side="right"))
            yield from names(table.slice(0, end))
            table = table.slice(end)
        if table.num_rows:
            owner, start, name = strings_of(table)
            order = np.argsort(name, kind="stable")
            same = name[order][1:] == name[order][:-1]
            twice = np.zeros(len(name), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            yield from found(table, owner[twice], start[twice])

    def strings_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(triple, start in it, name) of every string of the triples."""
        parts = table.column("bytes").to_pylist()
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        rolling = Rolling(np.frombuffer(b"".join(parts), np.uint8))
        counts = sizes - length + 1
        owner = np.repeat(np.arange(len(parts)), counts)
        start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = np.repeat(np.cumsum(sizes) - sizes, counts) + start
        to_gram = (table.column("before").to_numpy()[owner] - start).astype(np.uint64)
        name = rolling.parts(at, at + length) + to_gram * np.uint64(0x2545F4914F6CDD1D)
        return owner, start, mixed(name ^ table.column("gram").to_numpy().view(np.uint64)[owner])

    def found(table: pa.Table, owner: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        wanted = ~table.column("stands").to_numpy(zero_copy_only=False)[owner]
        owner, start = owner[wanted], start[wanted]
        if not len(owner):
            return
        new = np.append(True, (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1))  # runs of neighbouring strings
        first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(owner)) - 1
        base = table.column("start").to_numpy()[owner[first]]
        yield batch(table.column("_row").to_numpy()[owner[first]], base + start[first], base + start[last] + length, None, None)

    def names(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for a in range(0, table.num_rows, 2048):
            part = table.slice(a, 2048)
            owner, start, name = strings_of(part)
            base = part.column("start").to_numpy()[owner] + start
            yield batch(part.column("_row").to_numpy()[owner], base, base + length, name.view(np.int64), part.column("stands").to_numpy(zero_copy_only=False)[owner])

    def batch(row, start, end, name, stands) -> pa.RecordBatch:
        nothing = lambda kind: pa.nulls(len(row), kind)
        return pa.RecordBatch.from_pydict({"_row": pa.array(row), "start": pa.array(start), "end": pa.array(end),
                                           "name": nothing(pa.int64()) if name is None else pa.array(name),
                                           "stands": nothing(pa.bool_()) if stands is None else pa.array(stands)})

    out = written(triples.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "_row long, start long, end long, name long, stands boolean"), "merged")
    sent = out.where("name is not null")
    twice = sent.groupBy("name").count().where("count > 1").select("name")
    late = sent.join(twice, "name").where("not stands").select("_row", "start", "end")
    added = out.where("name is null").select("_row", "start", "end").union(late)
    return added.groupBy("_row").agg(F.collect_list(F.struct("start", "end")).alias("added"))  # of one text


def without_repeats(docs: DataFrame, keep: list[str], with_text: bool = False, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Per row of ``docs``: ``keep``, n_bytes, n_removed, n_spans, kept_sha256, spans(start, end), and what stays, as bytes and as text, if ``with_text``."""
    rows = first_cut(docs, marked(sampled(docs, length)), keep, length)
    added = merged(rows.where("strings is not null").select("_row", "strings"), length, group)
    # Only texts whose merge is open are dealt anew.
    open_ = rows.where("strings is not null").drop("strings").join(added, "_row", "left")
    shut = rows.where("strings is null").drop("strings").withColumn("added", F.lit(None).cast(dict(added.dtypes)["added"]))
    both = shut.unionByName(open_)
    kinds = {f.name: f.dataType.simpleString() for f in docs.select(*keep).schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part, texts in chunks(whole):
                out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept", "kept_text")}
                for text, spans, more in zip(texts, part.column("spans").to_pylist(), part.column("added").to_pylist()):
                    raw, all_spans = encoded(text), [*(spans or []), *(more or [])]
                    a, b = spans_of(np.array([s["start"] for s in all_spans], np.int64), np.array([s["end"] for s in all_spans], np.int64))
                    stays = cut(raw, a.tolist(), b.tolist())
                    for c, v in zip(out, (len(raw), len(raw) - len(stays), len(a), sha256(stays).hexdigest(),
                                          [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())], stays if with_text else None, stays.decode("utf-8", "ignore") if with_text else None)):
                        out[c].append(v)
                yield pa.RecordBatch.from_pydict({**{c: part.column(c) for c in keep}, **{c: pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")},
                                                  "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "spans": pa.array(out["spans"], _SPANS),
                                                  "kept": pa.array(out["kept"], pa.binary()),
                                                  "kept_text": pa.array(out["kept_text"], pa.string())})

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                        "spans array<struct<start: long, end: long>>, kept binary, kept_text string"])
    return both.select(*keep, "text", "spans", "added").mapInArrow(run, schema)


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of ``docs`` with the bytes that stay as their text, all other columns as they are.

    A character of which some bytes went goes as a whole.  A null text stays null.
    """
    rows = docs.select(F.struct("*").alias("_all"), "text")
    cut_ = without_repeats(rows, ["_all"], True, length)
    text = F.when(F.col("_all.text").isNotNull(), F.col("kept_text"))
    return cut_.select(*[text.alias("text") if c == "text" else F.col("_all").getField(c).alias(c) for c in docs.columns])
