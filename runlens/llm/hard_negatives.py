"""Hard negatives by an inverted multi-index.

Vectors are taken as whole numbers, floor(scale * x), and scored by their inner product, so all
scores are exact.  An anchor's positives are the best rows of its label; for each positive the
hard negatives are the best rows of other labels whose score lies between ``low`` and ``high`` hundredths of the
positive's.

Index.  The halves of the vectors have a codebook each, fitted by k-means on a bounded sample
(``SAMPLE`` rows); the codebooks hold about the fourth root of the number of rows.  A pair of
codewords is a cell, and every row lies in one.  A codeword's radius is the largest distance of any row's half from it.  Rows lie in
the order of cells, in shards of bounded size.

Search.  A group of anchors meets every shard.  For an anchor, a half's score with any row of a codeword is at most its
score with the codeword plus its length times the radius.  A heap over the two sorted lists of half
bounds (multi-sequence) yields the shard's cells by falling sum; their rows are scored.  The visit
stops when the window is certified: the next bound lies below the last place of the list, or
below the window's lower end.  So no row is left out that belongs to a result, whatever the codebooks.
Two such passes are made, one for the positives and one for the negatives of the windows they set.

Defined cases: rows whose id, label or vector is null, or that have a null or non-finite component (also after scaling), take no
part.  A shorter vector goes on with zeros.  Equal rows count once.  Rows with the anchor's id are neither its
positives nor its negatives.  Equal scores are ordered by the smaller id.  A negative positive score has an empty window.  An anchor
without positives, and an empty table, give no rows.  Whole components and scores beyond a long are held at its ends.  Other
columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written
from .common import bounded_sample, small_batches

SAMPLE, STEPS, MOST_WORDS = 4096, 8, 256
SHARD, GROUP, LANES, FAN_IN = 4096, 256, 4096, 64
#: Rows scored at once while cells are visited.
VISIT = 512

_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def whole_numbers(rows: DataFrame, scale: float) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, each once; ``v`` has whole numbers."""
    made = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                       F.transform(F.col("embedding"), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")).alias("v"),
                       F.transform(F.col("embedding"), lambda x: F.lit(float(scale)) * x.cast("double")).alias("raw"))
    finite = F.forall("raw", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(F.coalesce(x, F.lit(float("nan")))))
    return made.where("vec_id IS NOT NULL AND label IS NOT NULL AND raw IS NOT NULL").where(finite).select("vec_id", "label", "v").distinct()


def k_means(points: np.ndarray, words: int, seed: int) -> np.ndarray:
    """Codewords of ``points`` after a few rounds from points far apart by chance."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    words = distinct[rng.choice(len(distinct), min(words, len(distinct)), replace=False)]
    for _ in range(STEPS):
        nearest = assigned(points, words)
        sums = np.zeros_like(words)
        np.add.at(sums, nearest, points)
        times = np.bincount(nearest, minlength=len(words))[:, None]
        words = np.where(times > 0, sums / np.maximum(times, 1), words)
    return words


def assigned(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words * words).sum(axis=1) - 2.0 * points @ words.T, axis=1)


class Index:
    """Two codebooks with their radii."""

    def __init__(self, books: list[np.ndarray], dim: int, radii: list[np.ndarray] | None = None):
        self.books, self.dim, self.cut, self.radii = books, dim, dim // 2, radii

    def halves(self, v: np.ndarray) -> list[np.ndarray]:
        return [v[..., :self.cut], v[..., self.cut:]]

    def bounds(self, anchor: np.ndarray) -> list[np.ndarray]:
        """Upper bounds of the half scores with the rows of each codeword, a little wide for rounding."""
        out = []
        for half, book, radius in zip(self.halves(anchor), self.books, self.radii):
            length = np.sqrt((half * half).sum())
            slack = 1e-9 * length * (np.sqrt((book * book).sum(axis=1)) + radius) + 1e-6
            out.append(book @ half + length * radius + slack)
        return out


def cells_by_bound(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(bound, place in first, place in second) of all pairs by falling sum: the multi-sequence heap."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    if not x or not y:
        return
    heap, begun = [(-(x[0] + y[0]), 0, 0)], {(0, 0)}
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(a[i]), int(b[j])
        for u, w in ((i + 1, j), (i, j + 1)):
            if u < len(x) and w < len(y) and (u, w) not in begun:
                begun.add((u, w))
                heapq.heappush(heap, (-(x[u] + y[w]), u, w))


def products(rows: np.ndarray, anchor: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of whole numbers; ``most`` bounds their size."""
    if most < 2.0 ** 53:
        return (rows @ anchor).astype(np.int64)
    if most < 2.0 ** 62:
        return rows.astype(np.int64) @ anchor.astype(np.int64)
    own = [int(x) for x in anchor]
    return np.array([min(max(sum(int(x) * y for x, y in zip(r, own)), _LOW), _HIGH) for r in rows], np.int64)


class Best:
    """The first ``most`` (score, id) by falling score, then by id."""

    def __init__(self, most: int, ids: np.ndarray | None = None, scores: np.ndarray | None = None):
        self.most = most
        self.ids = np.zeros(0, np.int64) if ids is None else ids
        self.scores = np.zeros(0, np.int64) if scores is None else scores

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(self.ids) == self.most:
            on = scores >= self.scores[-1]
            ids, scores = ids[on], scores[on]
        if len(ids):
            ids, scores = np.append(self.ids, ids), np.append(self.scores, scores)
            order = np.lexsort((ids, np.invert(scores)))[:self.most]  # ~s falls as s rises, without overflow
            self.ids, self.scores = ids[order], scores[order]

    def beaten(self, bound: float) -> bool:
        """Nothing of this bound or less can enter."""
        return len(self.ids) == self.most and bound < float(self.scores[-1])


def search(index: Index, anchor: np.ndarray, shard: "Shard", take, done) -> int:
    """Visits the shard's cells by their bounds; the number of scored rows.

    ``take(ids, labels, scores)`` gets the rows, ``done(bound)`` says whether rows of this bound or less can matter no more.
    """
    bounds = index.bounds(anchor)
    most = shard.most * np.abs(anchor).max(initial=0.0) * max(1, len(anchor))
    waiting, rows, scored = [], 0, 0

    def score() -> int:
        at = np.concatenate(waiting)
        take(shard.ids[at], shard.labels[at], products(shard.v[at], anchor, most))
        return len(at)

    for bound, i, j in cells_by_bound(bounds[0][shard.words[0]], bounds[1][shard.words[1]]):
        if rows >= VISIT:
            scored, waiting, rows = scored + score(), [], 0
        if not rows and done(bound):
            return scored
        cell = shard.cells.get((int(shard.words[0][i]), int(shard.words[1][j])))
        if cell is not None:
            waiting.append(np.arange(*cell))
            rows += cell[1] - cell[0]
    return scored + score() if rows else scored


class Shard:
    def __init__(self, n: int, dim: int, ids: bytes, labels: bytes, codes: bytes, v: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.v = np.frombuffer(v, np.float64).reshape(n, dim)
        self.most = np.abs(self.v).max(initial=0.0)
        codes = np.frombuffer(codes, np.int32).reshape(n, 2)
        heads = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]).any(axis=1)))
        ends = np.append(heads[1:], n)
        self.cells = {(int(a), int(b)): (int(s), int(e)) for (a, b), s, e in zip(codes[heads], heads, ends)}
        self.words = [np.unique(codes[:, 0]), np.unique(codes[:, 1])]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists as rows of one length; a shorter list goes on with zeros."""
    sizes = np.asarray(pa.compute.list_value_length(column), np.int64)
    out = np.zeros((len(column), dim))
    flat = np.asarray(pa.compute.list_flatten(column), np.float64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def fitted(rows: DataFrame) -> tuple[Index | None, int]:
    """Codebooks of a sample, and the number of rows."""
    found = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    n, dim = found[0], found[1] or 0
    if not n:
        return None, 0
    sample = bounded_sample(rows, SAMPLE, "vec_id").select("vec_id", "v").toArrow().sort_by("vec_id")
    points = matrix(sample.column("v").combine_chunks(), dim)
    words = int(min(MOST_WORDS, max(2, round(n ** 0.25))))
    index = Index([], dim)
    index.books = [k_means(half, words, seed) for seed, half in enumerate(index.halves(points))]
    return index, n


def placed(rows: DataFrame, index: Index) -> tuple[DataFrame, Index]:
    """Rows with their two codewords, stored, and the index with its radii."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), index.dim)
            codes = [assigned(h, b) for h, b in zip(index.halves(v), index.books)]
            far = [np.sqrt(((h - b[c]) ** 2).sum(axis=1)) for h, b, c in zip(index.halves(v), index.books, codes)]
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id"), "label": batch.column("label"), "one": pa.array(codes[0].astype(np.int32)),
                "two": pa.array(codes[1].astype(np.int32)), "far_one": pa.array(far[0]), "far_two": pa.array(far[1]),
                "v": pa.array([x.tobytes() for x in v], pa.binary())})

    coded = written(rows.mapInArrow(run, "vec_id long, label long, one int, two int, far_one double, far_two double, v binary"), "coded")
    radii = []
    for code, far, book in (("one", "far_one", index.books[0]), ("two", "far_two", index.books[1])):
        radius = np.zeros(len(book))
        for r in coded.groupBy(code).agg(F.max(far).alias("far")).collect():  # one row a codeword
            radius[r[0]] = r[1]
        radii.append(radius)
    return coded, Index(index.books, index.dim, radii)


def _pack(batches: Iterator[pa.RecordBatch], most: int, codes: bool, dim: int) -> Iterator[pa.RecordBatch]:
    """Rows of a partition in order, ``most`` to a packed row."""
    made, held = 0, None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        while held.num_rows >= most:
            yield _packed(held.slice(0, most), made, codes, dim)
            made, held = made + 1, held.slice(most)
    if held is not None and held.num_rows:
        yield _packed(held, made, codes, dim)


def _packed(rows: pa.Table, made: int, codes: bool, dim: int) -> pa.RecordBatch:
    number = (TaskContext.get().partitionId() << 32) + made
    longs = lambda c: rows.column(c).to_numpy().astype(np.int64).tobytes()
    out = {"number": [number], "n": pa.array([rows.num_rows], pa.int32()), "ids": [longs("vec_id")], "labels": [longs("label")],
           "v": [b"".join(rows.column("v").to_pylist())]}
    if codes:
        out["codes"] = [np.stack([rows.column(c).to_numpy() for c in ("one", "two")], axis=1).astype(np.int32).tobytes()]
    return pa.RecordBatch.from_pydict(out)


def _merged(rows: pa.Table, most: int, lists: int) -> np.ndarray:
    """The rows of ``rows(member, list, id, score)`` that are among the ``most`` best of their (member, list)."""
    member, which = rows.column("member").to_numpy(), rows.column("list").to_numpy()
    ids, scores = rows.column("id").to_numpy(), rows.column("score").to_numpy()
    order = np.lexsort((ids, np.invert(scores), which, member))
    key = (member * lists + which)[order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    place = np.arange(len(key)) - np.repeat(heads, np.diff(np.append(heads, len(key))))
    return order[place < most]


def met(groups: DataFrame, shards: DataFrame, lanes: int) -> DataFrame:
    """Every group beside every shard: a copy of the group, its columns as ``g_...``, goes to each lane of shards.

    The copies grow with groups times shards while Spark takes them for as small as the groups, so they are never broadcast.
    """
    spread = shards.withColumn("lane", F.pmod(F.xxhash64("number"), F.lit(max(1, lanes))))
    copies = groups.select(F.col("number").alias("group"), F.col("n").alias("g_n"), F.col("ids").alias("g_ids"), F.col("labels").alias("g_labels"),
                           F.col("v").alias("g_v"), *[c for c in groups.columns if c not in ("number", "n", "ids", "labels", "v")],
                           F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, lanes - 1)).cast("long"))).alias("lane"))
    return copies.hint("merge").join(spread, "lane")


def passed(groups: DataFrame, shards: DataFrame, index: Index, label: str, asks, lists: int, most: int) -> DataFrame:
    """(group, member, list, id, score): the ``most`` best rows for each of an anchor's ``lists`` lists over all shards.

    ``asks(row)`` gives for a group's row one (take, done) maker per anchor.  Every group is copied to every lane of
    shards; what a task finds for a group it merges before it hands it on, and lanes are merged ``FAN_IN`` at a time.
    """
    spark = groups.sparkSession
    paired = met(groups, shards, min(LANES, shards.count()))
    dim = index.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int, int, int], Best] = {}
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["n"], dim, row["ids"], row["labels"], row["codes"], row["v"])
                ids, labels = np.frombuffer(row["g_ids"], np.int64), np.frombuffer(row["g_labels"], np.int64)
                v = np.frombuffer(row["g_v"], np.float64).reshape(len(ids), dim)
                asked = asks(row)
                for k in range(len(ids)):
                    best = [found.setdefault((row["group"], row["lane"] // FAN_IN, k, x), Best(most)) for x in range(lists)]
                    take, done = asked(k, int(ids[k]), int(labels[k]), best)
                    search(index, v[k], shard, take, done)
            if len(found) > 64 * GROUP * lists:
                yield from _rows(found)
                found = {}
        yield from _rows(found)

    made = paired.mapInArrow(run, "group long, part long, member int, list int, id long, score long")
    with small_batches(spark, 16):
        made = written(made, label)

    def merge(rows: pa.Table) -> pa.Table:
        return rows.take(pa.array(_merged(rows, most, lists)))

    schema = "group long, part long, member int, list int, id long, score long"
    first = made.groupBy("group", "part").applyInArrow(lambda rows: merge(rows), schema)
    return written(first.groupBy("group").applyInArrow(lambda rows: merge(rows), schema).drop("part"), label)


def _rows(found: dict) -> Iterator[pa.RecordBatch]:
    kept = [(k, b) for k, b in found.items() if len(b.ids)]
    if kept:
        times = [len(b.ids) for _, b in kept]
        keys = np.repeat(np.array([k for k, _ in kept], np.int64), times, axis=0)
        yield pa.RecordBatch.from_pydict({
            "group": pa.array(keys[:, 0]), "part": pa.array(keys[:, 1]), "member": pa.array(keys[:, 2].astype(np.int32)), "list": pa.array(keys[:, 3].astype(np.int32)),
            "id": pa.array(np.concatenate([b.ids for _, b in kept])), "score": pa.array(np.concatenate([b.scores for _, b in kept]))})


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``vec_id, label, embedding``; ``anchor`` is a condition on ``vec_id``.
    """
    spark = rows.sparkSession
    used = written(whole_numbers(rows, scale), "whole")
    index, n = fitted(used)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if index is None:
        return spark.createDataFrame([], schema)
    coded, index = placed(used, index)
    dim = index.dim
    base = "number long, n int, ids binary, labels binary, v binary"
    laid = coded.repartitionByRange("one", "two", "vec_id").sortWithinPartitions("one", "two", "vec_id", "label")
    shards = written(laid.select("vec_id", "label", "one", "two", "v").mapInArrow(lambda b: _pack(b, SHARD, True, dim), f"{base}, codes binary"), "shards")
    chosen = coded.where(anchor).select("vec_id", "label", "v")
    parts = max(1, -(-chosen.count() // GROUP))
    groups = written(chosen.repartition(parts).mapInArrow(lambda b: _pack(b, GROUP, False, dim), base), "groups")

    def same_label(row):
        def ask(k, own, label, best):
            def take(ids, labels, scores):
                on = (labels == label) & (ids != own)
                best[0].add(ids[on], scores[on])
            return take, best[0].beaten
        return ask

    found = passed(groups, shards, index, "positives", same_label, 1, positives)

    # The positives of a group go beside its anchors, as the windows of the second pass.
    def aims(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("member", "ascending"), ("score", "descending"), ("id", "ascending")])
        member = rows.column("member").to_numpy().astype(np.int64)
        place = np.arange(len(member)) - np.searchsorted(member, member)
        flat = np.stack([member, place, rows.column("id").to_numpy(), rows.column("score").to_numpy()], axis=1).astype(np.int64)
        return pa.table({"number": rows.column("group").slice(0, 1), "aims": pa.array([flat.tobytes()], pa.binary())})

    aimed = written(found.groupBy("group").applyInArrow(lambda rows: aims(rows), "number long, aims binary"), "aims")

    def windows(row):
        flat = np.frombuffer(row["aims"], np.int64).reshape(-1, 4)

        def ask(k, own, label, best):
            at = [int(s) for s in flat[flat[:, 0] == k][:, 3]]
            ends = [(-(-low * s // 100), high * s // 100) for s in at]  # the least and the greatest whole score inside

            def take(ids, labels, scores):
                other = (labels != label) & (ids != own)
                ids, scores = ids[other], scores[other]
                for (a, b), list_ in zip(ends, best):
                    on = (scores >= a) & (scores <= b)
                    list_.add(ids[on], scores[on])

            def done(bound):
                return all(a > b or bound < a or list_.beaten(bound) for (a, b), list_ in zip(ends, best))
            return take, done
        return ask

    mined = passed(groups.join(aimed, "number"), shards, index, "negatives", windows, positives, negatives)

    def told(rows: pa.Table, groups: pa.Table) -> pa.Table:
        out = {c.split()[0]: [] for c in schema.split(", ")}
        if rows.num_rows and groups.num_rows:
            ids = np.frombuffer(groups.column("ids")[0].as_py(), np.int64)
            aim = {(int(m), int(p)): (int(i), int(s)) for m, p, i, s in np.frombuffer(groups.column("aims")[0].as_py(), np.int64).reshape(-1, 4)}
            rows = rows.sort_by([("member", "ascending"), ("list", "ascending"), ("score", "descending"), ("id", "ascending")])
            last, rank = None, 0
            for m, x, i, s in zip(*(rows.column(c).to_pylist() for c in ("member", "list", "id", "score"))):
                rank = rank + 1 if (m, x) == last else 1
                last = (m, x)
                for name, value in zip(out, (int(ids[m]), aim[m, x][0], rank, i, aim[m, x][1], s)):
                    out[name].append(value)
        types = {"rank": pa.int32()}
        return pa.table({k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()})

    named = groups.join(aimed, "number").select(F.col("number").alias("group"), "ids", "aims")
    return mined.groupBy("group").cogroup(named.groupBy("group")).applyInArrow(lambda left, right: told(left, right), schema)
