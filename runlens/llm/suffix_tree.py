"""Language model scoring by a probabilistic suffix tree.

The model spells texts: the symbols are the bytes of the words (A-Z in lower case), one
separator between words and one end.  A context is the last one to ``DEPTH`` symbols.

* Counting: every place of a training text gives one number that packs its symbol and
  the ``DEPTH`` symbols before it.  Tasks count equal numbers, Spark adds the counts up.  Shorter
  contexts follow by dropping the earliest symbol, level by level.
* Growing: a context is a candidate if it makes up at least ``LEAST`` of all places, which
  bounds the tree: at most ``DEPTH / LEAST`` contexts whatever the corpus.  It is retained if its
  next-symbol distribution diverges from its suffix's by more than the parameters it costs are worth
  (log-likelihood gain against half the log of the places per symbol), or if a longer context behind it is.
* Smoothing: with n places and t distinct next symbols, a retained context gives the seen ones c / (n + t), and hands
  the rest to its suffix; the empty context hands it to all 256 symbols evenly.
* Scoring: every place is scored by its longest retained suffix.

Word counts for the unigram base are kept apart, by a 64-bit hash of the word.  Words that make up ``COMMON`` or more of all
tokens (at most 1 / COMMON of them) go to all executors; the others' counts are joined.

Defined cases: a null or empty text is the end alone.  Repeated rows are scored, and counted, each for itself.  A null id
is not held out.  Without training rows the model is uniform over symbols.  An empty table gives an
empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written
from .common import chunks, held_out, whole_text
from .words import Coded, Spelled, words_in

DEPTH = 6
LEAST = 5e-7
ENTRY_PART = 64  # next symbols rarer than LEAST / ENTRY_PART are left to the suffix
COMMON = 1e-6
SYMBOLS = 256
SENT_ROWS = 100_000  # of one Arrow batch of counts: the JVM takes each batch as one piece of memory outside its heap
CHUNK_BYTES = 2 << 20  # every byte takes some 40 bytes of numbers while it is handled
BEFORE, BETWEEN, END = b"\r", b" ", b"\n"  # never part of a word


def spelled(texts: list[str], lists: list[list[bytes]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All places of the texts: (packed context and symbol, number of the text), and words per text.

    A packed number holds the symbol in its lowest byte and the context in its highest, latest symbol first, so
    that a shorter context is a prefix of a longer one.
    """
    lists = words_in(texts, lower=True) if lists is None else lists
    parts = [BEFORE * DEPTH + BETWEEN.join(x) + END for x in lists]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    n = len(raw) - DEPTH
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    key = raw[DEPTH:].astype(np.uint64)
    for d in range(1, DEPTH + 1):
        key |= raw[DEPTH - d:DEPTH - d + n].astype(np.uint64) << np.uint64(64 - 8 * d)
    real = raw[DEPTH:] != BEFORE[0]
    doc = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)[DEPTH:]
    return key[real], doc[real], np.fromiter(map(len, lists), np.int64, len(lists))


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of two count tables."""
    keys, n = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(keys, kind="stable")  # two sorted runs
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def word_hashes(coded: Coded) -> np.ndarray:
    return Spelled(coded.words).hashes()


END_HASH = Spelled([END]).hashes()[0]


def sent(kind: int, counts: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(counts[0]), SENT_ROWS):
        keys, n = (c[at:at + SENT_ROWS] for c in counts)
        yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(keys), kind, np.int32)), "key": pa.array(keys.view(np.int64)), "n": pa.array(n.astype(np.int64))})


def count(train: DataFrame) -> DataFrame:
    """(kind, key, n): places (kind 0) and words (kind 1) of the training texts, added up and stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        held = {0: [nothing], 1: [nothing]}
        for batch in batches:
            for _, texts in chunks(batch, limit=CHUNK_BYTES):
                lists = words_in(texts, lower=True)
                held[0].append(counted(spelled(texts, lists)[0]))
                coded = Coded(texts, lists=lists)
                h = word_hashes(coded)
                order = np.argsort(h)
                n = np.bincount(coded.codes, minlength=len(h))
                held[1].append((np.append(h[order], END_HASH), np.append(n[order], len(texts))))
                for kind, tables in held.items():
                    while len(tables) > 1 and len(tables[-1][0]) * 2 > len(tables[-2][0]):  # like sizes are merged
                        tables[-2:] = [added(tables[-2], tables[-1])]
                    if len(tables[0][0]) > 1_000_000:  # bounds the memory; Spark adds up what is sent on
                        yield from sent(kind, tables.pop(0))
                        tables.append(nothing)
        for kind, tables in held.items():
            whole = nothing
            for t in tables:
                whole = added(whole, t)
            yield from sent(kind, whole)

    rows = train.select(whole_text().alias("text")).mapInArrow(run, "kind int, key long, n long")
    # Tasks have added up their own: laid out first, the rows are not put through another table before the shuffle.
    return written(rows.repartition("kind", "key").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")


@dataclass
class Level:
    """Retained contexts of one length: sorted packed contexts, what they hand on; sorted (context, symbol) and their probability here."""

    contexts: np.ndarray
    rest: np.ndarray
    entries: np.ndarray
    share: np.ndarray


@dataclass
class Tree:
    root: np.ndarray
    levels: list[Level]

    def probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Probability of the symbol of each packed place; ``keys`` sorted for speed."""
        p = self.root[keys & np.uint64(255)]
        left = np.arange(len(keys))  # places whose context so far is there: only of these a longer one can be
        for d, level in enumerate(self.levels, 1):
            if not len(level.contexts) or not len(left):
                break
            context = keys & mask(d)
            first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
            at = np.minimum(np.searchsorted(level.contexts, context[first]), len(level.contexts) - 1)
            there = level.contexts[at] == context[first]
            times = np.diff(np.append(first, len(keys)))
            goes_on = np.repeat(there, times)
            keys, left = keys[goes_on], left[goes_on]
            share = np.zeros(len(keys))
            if len(level.entries):
                entry = context[goes_on] | (keys & np.uint64(255))
                e = np.minimum(np.searchsorted(level.entries, entry), len(level.entries) - 1)
                share = np.where(level.entries[e] == entry, level.share[e], 0.0)
            p[left] = share + np.repeat(level.rest[at[there]], times[there]) * p[left]
        return p


def mask(d: int) -> np.uint64:
    return np.uint64(((1 << 8 * d) - 1) << (64 - 8 * d)) if d else np.uint64(0)


def signed_mask(d: int) -> int:
    m = int(mask(d)) | 255
    return m - (1 << 64) if m >= 1 << 63 else m


def grow(counts: DataFrame, least: float = LEAST) -> Tree:
    """The tree from the counted places: candidates by Spark, level by level; the divergence tests on them here."""
    level = counts.where("kind = 0").select("key", "n")
    places = level.agg(F.sum("n")).first()[0] or 0
    if not places:
        return Tree(np.full(SYMBOLS, 1.0 / SYMBOLS), [])
    candidates = {}
    for d in range(DEPTH, -1, -1):
        if d < DEPTH:
            level = written(level.groupBy(F.col("key").bitwiseAND(F.lit(signed_mask(d))).alias("key")).agg(F.sum("n").alias("n")), "level")
        top = signed_mask(d) & ~255
        with_context = level.withColumn("context", F.col("key").bitwiseAND(F.lit(top)))
        sums = with_context.groupBy("context").agg(F.sum("n").alias("places"), F.count("*").alias("kinds")).where(F.col("places") >= least * places)
        fine = with_context.where(F.col("n") >= least * places / ENTRY_PART).join(sums, "context").select("key", "n", "places", "kinds")
        candidates[d] = fine.toArrow()  # bounded by least
    return test(candidates, places)


def test(candidates: dict[int, pa.Table], places: int) -> Tree:
    """Retains contexts from the empty one on; a candidate that does not diverge is dropped unless a longer one behind it stays."""
    price = 0.5 * np.log(max(places, 2))
    root = np.full(SYMBOLS, 0.0)
    levels: list[Level] = []
    kept: list[np.ndarray] = []
    tree = Tree(root, levels)
    for d in range(DEPTH + 1):
        t = candidates[d]
        key = t.column("key").to_numpy().view(np.uint64)
        order = np.argsort(key)
        key, n = key[order], t.column("n").to_numpy()[order]
        total, kinds = t.column("places").to_numpy()[order], t.column("kinds").to_numpy()[order]
        if d == 0:
            share = n / (total + kinds)
            np.add.at(root, key & np.uint64(255), share)
            root += max(0.0, 1.0 - root.sum()) / SYMBOLS
            continue
        context = key & mask(d)
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(key) else np.zeros(0, np.int64)
        share = n / (total + kinds)
        rest = 1.0 - np.add.reduceat(share, first) if len(first) else np.zeros(0)
        if len(first):
            gain = n * np.log((n / total) / tree.probabilities(key))
            kept.append(np.add.reduceat(gain, first) > price * kinds[first])
        else:
            kept.append(np.zeros(0, bool))
        levels.append(Level(context[first], np.maximum(rest, 0.0), key, share))
    for d in range(DEPTH, 0, -1):
        level, stays = levels[d - 1], kept[d - 1]
        if d < DEPTH:
            behind = np.unique(levels[d].contexts & mask(d))
            stays = stays | np.isin(level.contexts, behind)
        contexts = level.contexts[stays]
        fine = np.isin(level.entries & mask(d), contexts)
        levels[d - 1] = Level(contexts, level.rest[stays], level.entries[fine], level.share[fine])
    return tree


def located(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key in the sorted ``known`` that has them all: by a table of hashes, and by search where two hashes meet."""
    if not len(keys):
        return np.zeros(0, np.int64)
    shift = np.uint64(64 - (len(known).bit_length() + 2))
    slot = lambda k: ((k * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
    table = np.zeros(1 << int(np.uint64(64) - shift), np.int32)
    table[slot(known)] = np.arange(len(known), dtype=np.int32)
    at = table[slot(keys)]
    missed = np.flatnonzero(known[at] != keys)
    at[missed] = np.searchsorted(known, keys[missed])
    return at


def score(docs: DataFrame, tree: Tree, common: tuple[np.ndarray, np.ndarray], tokens: int, distinct: int) -> DataFrame:
    """Stored per row: doc_id, row number, n_tokens, score, the common words' part of the base, and the other words as (hash, times)."""
    shared = docs.sparkSession.sparkContext.broadcast((tree, *common))
    z = float(np.log10(tokens + 0.1 * (distinct + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, known_n = shared.value
        for batch in batches:
            for part, texts in chunks(batch, limit=CHUNK_BYTES):
                lists = words_in(texts, lower=True)
                key, doc, words = spelled(texts, lists)
                keys = counted(key)[0]
                logs = np.log10(np.maximum(model.probabilities(keys), 1e-300))
                total = np.bincount(doc, weights=logs[located(keys, key)], minlength=len(texts))
                coded = Coded(texts, lists=lists)
                h = np.append(word_hashes(coded), END_HASH)
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                found = known[at] == h if len(known) else np.zeros(len(h), bool)
                c = np.where(found, known_n[at] if len(known) else 0, 0)
                value = np.where(found, np.log10(c + 0.1) - z, 0.0)
                base = np.bincount(coded.doc, weights=value[coded.codes], minlength=len(texts)) + value[-1]
                seen = np.bincount(coded.doc, weights=found[coded.codes], minlength=len(texts)).astype(np.int64) + int(found[-1])
                other = np.flatnonzero(~found[coded.codes])
                pair, times = counted((coded.doc[other].astype(np.uint64) << np.uint64(32)) | coded.codes[other].astype(np.uint64))
                owner, code = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
                if not found[-1]:  # the end is not common: without training rows
                    owner, code = np.append(owner, np.arange(len(texts))), np.append(code, np.full(len(texts), len(coded.words)))
                    times = np.append(times, np.ones(len(texts), np.int64))
                    order = np.argsort(owner, kind="stable")
                    owner, code, times = owner[order], code[order], times[order]
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int32)
                rare = pa.StructArray.from_arrays([pa.array(h[code].view(np.int64)), pa.array(times.astype(np.int32))], ["hash", "times"])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "row": part.column("row"), "held_out": part.column("held_out"), "n_tokens": pa.array(words + 1),
                    "score": pa.array(total), "base": pa.array(base), "known": pa.array(seen), "rare": pa.ListArray.from_arrays(pa.array(ends), rare)})

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "held_out", whole_text().alias("text"))
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return written(rows.mapInArrow(run, f"doc_id {kind}, row long, held_out boolean, n_tokens long, score double, base double, known long, "
                                        "rare array<struct<hash: long, times: int>>"), "scored")


def suffix_tree_scores(docs: DataFrame, folds: int = 10, least: float = LEAST) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10).

    The model learns from the rows that are not held out.
    """
    marked = docs.select("doc_id", "text", held_out("doc_id", folds).alias("held_out"))
    counts = count(marked.where("not held_out"))
    words = counts.where("kind = 1").select(F.col("key").alias("hash"), "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("words")).first()
    tokens, distinct = int(total["tokens"]), int(total["words"])
    common = words.where(F.col("n") >= COMMON * tokens).toArrow()  # at most 1 / COMMON rows
    h, n = common.column("hash").to_numpy().view(np.uint64), common.column("n").to_numpy()
    order = np.argsort(h)
    scored = score(marked, grow(counts, least), (h[order], n[order]), tokens, distinct)
    z = float(np.log10(tokens + 0.1 * (distinct + 1)))
    c = F.coalesce(F.col("n"), F.lit(0))
    rest = (scored.select("row", F.inline("rare")).join(words, "hash", "left").groupBy("row")
            .agg(F.sum(F.col("times") * (F.log10(c + 0.1) - z)).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("also")))
    return (scored.drop("rare").join(rest, "row", "left")
            .select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score"))
