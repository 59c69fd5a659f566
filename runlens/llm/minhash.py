"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of word shingles, bands, and exact checks of what shares a band.

Signatures.  A document is a multiset of shingles of five words; a shingle found c times
has weight c.  Weights are discretised to whole numbers, and the axis of weights is cut
into [0,1), [1,2), [2,4), [4,8) ...  Every (shingle, interval) has a Poisson process whose rate
is the interval's length: its points fall at times that a hash fixes, each with a place on the
interval and one of the signature's components.  Points above the shingle's weight don't
count.  A component is the time of its earliest point, so two documents agree in a component
with the probability of their weighted Jaccard similarity.  Points after the time at which all
components are surely filled are never made, so a document costs about its length plus
(components * log components) points.

Candidates and links.  Documents with the same text are one node.  Nodes that share a band
of components are candidates.  Each member of a band's bucket is first checked against the
bucket's smallest node; members that are then in one component need no further checks
among each other.  Buckets that still hold several components are cut into blocks of members,
and blocks are compared as a whole: a product of incidence matrices counts the common shingles of all their pairs, and
only a spanning forest of the links comes out.  All checks count the real multisets.

Defined cases: a text without words (null or empty too) is alone in its class.  A text of one to
four words is one shingle.  Texts with equal words are similar to degree 1.  Repeated rows are copies.  A null id is kept as it is.
An empty table gives an empty result.  Other columns are ignored (``deduplicated``
keeps them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.blocks import ordered_scan
from ..plans.scratch import written
from .common import chunks, map_texts, small_batches, whole_text
from .components import components
from .words import Coded, Spelled, mixed

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 32, 5  # a pair at 0.8 shares no band with probability 3e-6
BLOCK, TOKENS, SLICE = 256, 1 << 20, 4096  # members and tokens of a block, and tokens compared at once

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, times) of each document's distinct shingles, and words per document."""
    coded = Coded(texts)
    own = Spelled(coded.words).hashes()
    n = len(coded.codes)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int64), coded.counts
    word = own[coded.codes]
    size = max(0, n - SHINGLE + 1)
    key = np.full(size, _C, np.uint64)
    for k in range(SHINGLE):
        key = mixed(key * _A + word[k:k + size])
    inside = coded.doc[:size] == coded.doc[SHINGLE - 1:] if size else np.zeros(0, bool)
    docs, keys = [coded.doc[:size][inside]], [key[inside]]
    starts = np.cumsum(coded.counts) - coded.counts
    for few in range(1, SHINGLE):
        short = np.flatnonzero(coded.counts == few)
        h = np.full(len(short), _B + np.uint64(few), np.uint64)
        for k in range(few):
            h = mixed(h * _A + word[starts[short] + k])
        docs.append(short.astype(np.int32))
        keys.append(h)
    doc, key = np.concatenate(docs), np.concatenate(keys)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(first)
    return doc[at], key[at], np.diff(np.append(at, len(doc))), coded.counts


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def signatures(doc: np.ndarray, key: np.ndarray, times: np.ndarray, docs: int, size: int) -> np.ndarray:
    """docs x size earliest times; infinite for documents without shingles."""
    out = np.full((docs, size), np.inf)
    weight = np.bincount(doc, weights=times, minlength=docs)
    todo = weight > 0
    # One process per (shingle, interval) whose interval begins below the shingle's weight.
    levels = np.ceil(np.log2(np.maximum(times, 1))).astype(np.int64) + 1
    of = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(of)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0.0, np.exp2(level - 1.0))
    length = np.where(level == 0, 1.0, low)
    seed = mixed(key[of] + (level.astype(np.uint64) + np.uint64(1)) * _B)
    p_doc, most = doc[of], times[of].astype(float)
    factor = size * (np.log(size) + 5.0)
    limit = np.where(todo, factor / np.maximum(weight, 1.0), 0.0)
    while todo.any():
        live = np.flatnonzero(todo[p_doc])
        at, x, n = seed[live], np.zeros(len(live)), 0
        while len(live):
            n += 1
            h = mixed(at + np.uint64(n * int(_A) % (1 << 64)))
            x = x - np.log(_unit(h)) / length[live]
            on = x <= limit[p_doc[live]]
            live, at, x, h = live[on], at[on], x[on], h[on]
            g = mixed(h ^ _C)
            counts = low[live] + _unit(g) * length[live] < most[live]
            part = (mixed(g + _B) % np.uint64(size)).astype(np.int64)
            np.minimum.at(out, (p_doc[live[counts]], part[counts]), x[counts])
        todo &= np.isinf(out).any(axis=1)
        limit = limit * 2.0
    return out


def bands(signature: np.ndarray, count: int, rows: int) -> np.ndarray:
    """docs x count hashes of the signature's bands."""
    raw = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), count, rows)
    h = np.broadcast_to(mixed(np.arange(count, dtype=np.uint64) + np.uint64(1)), raw.shape[:2]).copy()
    for r in range(rows):
        h = mixed(h * _A + raw[:, :, r])
    return h.view(np.int64)


def signed(docs: DataFrame, keep: list[str], count: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``keep``, the words, the weight (all shingles) and the band hashes of each text (null without words)."""
    def make(_, texts):
        doc, key, times, words = shingles(texts)
        made = bands(signatures(doc, key, times, len(texts), count * rows), count, rows)
        weight = np.bincount(doc, weights=times, minlength=len(texts)).astype(np.int64)
        flat = pa.array(made.reshape(-1))
        offsets = np.arange(len(texts) + 1, dtype=np.int32) * count
        lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(weight == 0, False)), flat)
        return {"weight": pa.array(weight), "bands": lists}

    return map_texts(docs, make, "weight long, bands array<long>", keep)


def similarity(left: list[str], right: list[str]) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of each pair of texts."""
    n = len(left)
    a, b = shingles(left), shingles(right)
    doc = np.concatenate([a[0], b[0]]).astype(np.int64)
    key, times = np.concatenate([a[1], b[1]]), np.concatenate([a[2], b[2]])
    total = np.bincount(doc, weights=times, minlength=n)
    order = np.lexsort((key, doc))
    doc, key, times = doc[order], key[order], times[order]
    same = np.flatnonzero((doc[1:] == doc[:-1]) & (key[1:] == key[:-1])) if len(doc) else np.zeros(0, np.int64)
    both = np.bincount(doc[same], weights=np.minimum(times[same], times[same + 1]), minlength=n)
    return both / np.maximum(total - both, 1.0)


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def nodes(docs: DataFrame, count: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): each document's id and text digest; each distinct text's number, weight and bands."""
    named = docs.select("doc_id", whole_text().alias("text"))
    all_rows = written(signed(named.withColumn("digest", digest(F.col("text"))), ["doc_id", "digest"], count, rows), "signed")
    distinct = all_rows.where("weight > 0").dropDuplicates(["digest"]).select("digest", "weight", "bands")
    # Stored, so that the numbers stay.
    return all_rows, written(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")


def checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs(a, b, ...)`` with the exact ``similarity``; ``texts(node, text)`` has every node once."""
    joined = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
              .join(texts.select(F.col("node").alias("b"), "text"), "b"))

    def run(batches):
        for batch in batches:
            left, right = batch.column("text_a").to_pylist(), batch.column("text").to_pylist()
            sims, start = [], 0
            sizes = np.cumsum([len(x) + len(y) for x, y in zip(left, right)])
            while start < len(left):
                end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + (4 << 20))))
                sims.append(similarity(left[start:end], right[start:end]))
                start = end
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "similarity": pa.array(np.concatenate(sims) if sims else np.zeros(0))})

    return joined.select("a", "b", "text_a", "text").mapInArrow(run, "a long, b long, similarity double")


def split_buckets(placed: DataFrame) -> DataFrame:
    """The rows of ``placed(bucket, component, ...)`` whose bucket holds several components."""
    split = placed.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("bucket")
    return placed.join(split, "bucket")


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The shingle multisets as sets, the c-th copy of a shingle being a token of its own: all tokens, and each text's number of them."""
    doc, key, times, _ = shingles(texts)
    of = np.repeat(np.arange(len(key)), times)
    copy = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
    return mixed(key[of] + copy.astype(np.uint64) * _C), np.bincount(doc[of], minlength=len(texts))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Shared tokens of each left and right set, by products of slices of their incidence matrices."""
    sizes = [np.fromiter(map(len, side), np.int64, len(side)) for side in (left, right)]
    flat = [np.concatenate(side) if len(side) else np.zeros(0, np.uint64) for side in (left, right)]
    common = np.intersect1d(*flat)
    at = []
    for side, n in zip(flat, sizes):
        place = np.searchsorted(common, side)
        found = np.flatnonzero(common[np.minimum(place, len(common) - 1)] == side) if len(common) else np.zeros(0, np.int64)
        order = found[np.argsort(place[found], kind="stable")]
        at.append((np.repeat(np.arange(len(n)), n)[order], place[order]))
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(common), SLICE):
        parts = []
        for (row, place), n in zip(at, sizes):
            a, b = np.searchsorted(place, [start, start + SLICE])
            m = np.zeros((len(n), min(SLICE, len(common) - start)), np.float32)
            m[row[a:b], place[a:b] - start] = 1.0
            parts.append(m)
        out += parts[0] @ parts[1].T  # whole numbers below 2^24: exact
    return out


def _joined(component: np.ndarray, other: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Of the linked ``pairs`` of components those of a spanning forest."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for i, (a, b) in enumerate(zip(component[pairs[:, 0]].tolist(), other[pairs[:, 1]].tolist())):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            kept.append(i)
    return pairs[kept]


def links_in_buckets(placed: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) between nodes of different components that share a bucket: enough of them to join all components that are linked at all.

    The members of a bucket are cut into blocks of ``BLOCK`` members or ``TOKENS`` tokens.  Every block meets every block of its bucket, and all
    their members are compared at once, as counts of common tokens; what comes out is a spanning forest of the links found.  So no pair of members is a row anywhere,
    and a bucket of any size is spread over many tasks.
    """
    def counted(batches):
        for batch in batches:
            for part, chunk in chunks(batch):
                each, n = tokens(chunk)
                cuts = np.cumsum(n)[:-1]
                yield pa.RecordBatch.from_pydict({"node": part.column("node"), "n": pa.array(n.astype(np.int64)),
                                                  "tokens": pa.array([np.sort(t).tobytes() for t in np.split(each, cuts)], pa.binary())})

    spelled = written(texts.join(placed.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(counted, "node long, n long, tokens binary"), "tokens")
    sized = placed.select("bucket", "node", "component").join(spelled.select("node", "n"), "node")
    at = ordered_scan(sized, ["bucket"], ["component", "node"]).total("_at", F.lit(1).cast("long")).total("_sum", F.col("n")).result()
    # A block has so many members and, but for a single longer text, so many tokens.
    at = at.select("bucket", "node", "component", (F.floor((F.col("_at") - 1) / BLOCK) + F.floor(F.col("_sum") / TOKENS)).cast("int").alias("block"))
    ends = at.groupBy("bucket").agg(F.max("block").alias("last"), F.min("block").alias("first"))
    alone = (F.col("first") == F.col("last")).alias("alone")
    blocked = at.join(ends, "bucket").select("bucket", "block", "last", alone, "node", "component").join(spelled.select("node", "tokens"), "node")

    def packed(key, rows: pa.Table) -> pa.Table:
        long = lambda c: rows.column(c).to_numpy().astype(np.int64).tobytes()
        sizes = np.fromiter((len(t) // 8 for t in rows.column("tokens").to_pylist()), np.int64, rows.num_rows)
        return pa.table({"bucket": [key[0].as_py()], "block": pa.array([key[1].as_py()], pa.int32()), "last": pa.array([key[2].as_py()], pa.int32()),
                         "alone": [key[3].as_py()], "nodes": [long("node")], "components": [long("component")],
                         "sizes": [sizes.tobytes()], "tokens": [b"".join(rows.column("tokens").to_pylist())]})

    def side(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        node, component, size = (np.frombuffer(row[prefix + c], np.int64) for c in ("nodes", "components", "sizes"))
        return node, component, np.split(np.frombuffer(row[prefix + "tokens"], np.uint64), np.cumsum(size)[:-1])

    def compared(prefix: str):
        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    (xn, xc, xt), (yn, yc, yt) = side(row, prefix), side(row, "")
                    both = overlaps(xt, yt).astype(np.float64)
                    total = np.fromiter(map(len, xt), np.float64, len(xt))[:, None] + np.fromiter(map(len, yt), np.float64, len(yt))
                    linked = (both / np.maximum(total - both, 1.0) >= similar) & (xc[:, None] != yc)
                    kept = _joined(xc, yc, np.argwhere(linked))
                    yield pa.RecordBatch.from_pydict({"a": pa.array(xn[kept[:, 0]]), "b": pa.array(yn[kept[:, 1]])})
        return run

    held = ["nodes", "components", "sizes", "tokens"]
    kind = "bucket long, block int, last int, alone boolean, " + ", ".join(f"{c} binary" for c in held)
    with small_batches(placed.sparkSession, 16):
        blocks = written(blocked.groupBy("bucket", "block", "last", "alone").applyInArrow(lambda key, rows: packed(key, rows), kind), "blocks")
        several = blocks.where("not alone")
        left = several.select("bucket", *[F.col(c).alias(f"x_{c}") for c in held], F.explode(F.sequence("block", "last")).alias("block"))
        pairs = left.join(several.select("bucket", "block", *held), ["bucket", "block"]).drop("bucket", "block")
        inside = blocks.where("alone").select(*held).mapInArrow(compared(""), "a long, b long")
        return written(inside.union(pairs.mapInArrow(compared("x_"), "a long, b long")), "links")


def links(docs: DataFrame, similar: float = SIMILAR, count: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, nodes, component of each linked node)."""
    all_rows, known = nodes(docs, count, rows)
    bucketed = known.select("node", F.explode("bands").alias("bucket"))
    leads = bucketed.groupBy("bucket").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = written(bucketed.join(leads, "bucket").select("bucket", "lead", "node"), "buckets")
    stars = members.where("lead <> node").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()

    wanted = members.select("node").distinct().join(known.select("node", "digest"), "node")
    held = docs.select(whole_text().alias("text")).withColumn("digest", digest(F.col("text")))
    texts = written(held.join(wanted, "digest").select("node", "text").dropDuplicates(["node"]), "texts")

    linked = written(checked(stars, texts).where(F.col("similarity") >= similar).select("a", "b"), "links")
    found = written(components(linked), "components")

    # Buckets that still hold several components.
    placed = members.join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    second = links_in_buckets(written(split_buckets(placed), "split"), texts, similar)
    merged = written(components(linked.union(second)), "components")
    return all_rows, known, merged


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, count: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id``, ``digest`` of the text, ``class_id`` and ``is_kept`` per row of ``docs``.

    A class is a connected set of texts linked by a similarity of ``similar`` or more; its id is its
    smallest document id, and that document is the one to keep.
    """
    all_rows, known, merged = links(docs, similar, count, rows)
    named = (known.select("digest", "node").join(merged, "node", "left")
             .select("digest", F.coalesce("component", "node").alias("component")))
    placed = written(all_rows.join(named, "digest", "left").select("doc_id", "digest", "component"), "placed")
    least = (placed.where("component is not null").groupBy("component")
             .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("least")))
    alone, first = F.col("component").isNull(), F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("digest") == F.col("least.digest"))
    return (placed.join(least, "component", "left")
            .select("doc_id", "digest", F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("class_id"),
                    F.when(alone, True).otherwise(first).alias("is_kept")))


def deduplicated(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each class, with all its columns.

    Rows without words stay.  Of repeated rows of the kept document one stays.
    """
    kept = (near_duplicates(docs, similar).where("is_kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_kept")).distinct())
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", digest(whole_text()).alias("_digest"),
                       (F.length(F.translate(whole_text(), " \t\n\u000b\f\r", "")) > 0).alias("_words"))
    stays = rows.where("_words").join(kept, (F.col("_digest") == F.col("_kept")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    once = stays.dropDuplicates(["doc_id", "_digest"])
    return once.union(rows.where("not _words")).select("_row.*")
