"""A content-addressed manifest of a table: digests of rows, a tree of fan 16 per source, one over the sources, and proofs.

Leaves.  A row's leaf is the sha256 of its fields, each ``-`` if null, else its UTF-8 byte
count, ``:`` and the value.  Leaves of a source are numbered by ``doc_id``; numbers are found by
ranges, so a source of any size is spread over all tasks.  Every 16 consecutive nodes become one
node, the sha256 of their digests, while more than one remains; the last is the source's subroot.  Subroots in
the order of the sources (null first, then by bytes) make a tree in the same way.

Store.  Each inner node is one record: its digest and its children's digests.  A record's name is
its content, so equal nodes are stored once.

Proofs.  Requests for leaves descend from the root by the base-16 digits of the
source's and the leaf's number.  A request looks up the record of the digest it has reached,
goes on with the child of its digit, and collects the others, left and right of it.  Requests with a common
beginning go down as one, so the record of a hot node is looked up once for each of its
children.  The collected path, reversed, is the proof from the leaf up; folding it with a leaf gives a root.

Defined cases: nulls in any field are fields of their own (``-``); an empty text is ``0:``.  A null
``doc_id`` comes first in its source.  Repeated rows are leaves of their own, in consecutive places; rows
with one id are ordered by their digest.  A source of one row is its own leaf; a table of one source
has that subroot as its root.  An empty table has no leaves, records or root.  Other columns of the
table are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.blocks import ordered_scan
from ..plans.scratch import written

FAN = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(**changed: Column) -> Column:
    """The leaf of a row of ``documents``; ``changed`` replaces fields by other values."""
    return F.sha2(F.concat(*[field(changed.get(name, F.col(name))) for name in FIELDS]), 256)


def tampered_text() -> Column:
    return F.translate("text", UPPER, LOWER)


@dataclass
class Manifest:
    """``store(digest, children)``, ``leaves(key, rank, n, doc_id, leaf, other)``, ``sources(key, rank, n, subroot, of)`` (``of``
    sources in all) and the ``root`` (None for an empty table).  ``key`` names a source: ``0`` is null, else ``1`` and its name."""

    store: DataFrame
    leaves: DataFrame
    sources: DataFrame
    root: str | None


def _run(rank: Column, size: int = FAN) -> Column:
    return F.shiftright(rank, size.bit_length() - 1)


def _numbered(nodes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    one = F.lit(1).cast("long")
    told_apart = nodes.withColumn("_row", F.monotonically_increasing_id())  # equal rows: any order, but the same both ways
    counted = ordered_scan(told_apart, keys, [*order, "_row"]).total("rank", one).rest("n", one).result().drop("_row")
    return counted.withColumns({"n": F.col("rank") + F.col("n") - 1, "rank": F.col("rank") - 1})


def _tree(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Records of each level and (key, n, top) of ``nodes(key, rank, n, digest)``; a group has ``n`` nodes at the lowest level."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    records, tops, size = [], [], 1
    while True:
        tops.append(nodes.where(F.col("n") <= size).select("key", "n", F.col("digest").alias("top")))
        if most <= size:
            break
        held = (nodes.where(F.col("n") > size).groupBy("key", "n", _run(F.col("rank")).alias("run"))
                .agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("nodes")))
        made = held.select("key", F.col("run").alias("rank"), "n", F.col("nodes.digest").alias("children"))
        nodes = written(made.withColumn("digest", F.sha2(F.array_join("children", ""), 256)), "level")
        records.append(nodes.select("digest", "children"))
        size *= FAN
    top = tops[0]
    for more in tops[1:]:
        top = top.union(more)
    return records, top


def manifest(docs: DataFrame, other: Column | None = None) -> Manifest:
    """The manifest of ``docs``; ``other`` is a digest to fold instead of a row's own leaf (null: its own)."""
    source = F.col("source").cast("string")
    leaf = leaf_digest()
    rows = docs.select(F.when(source.isNull(), "0").otherwise(F.concat(F.lit("1"), source)).alias("key"), "doc_id", leaf.alias("leaf"),
                       (F.lit(None).cast("string") if other is None else other).alias("other"))
    leaves = written(_numbered(rows, ["key"], ["doc_id", "leaf"]), "leaves")
    records, tops = _tree(leaves.select("key", "rank", "n", F.col("leaf").alias("digest")))

    whole = F.lit("").alias("all")
    named = _numbered(tops.select(whole, "key", F.col("n").alias("rows"), F.col("top").alias("subroot")), ["all"], ["key"])
    sources = written(named.select("key", "rank", F.col("n").alias("of"), F.col("rows").alias("n"), "subroot"), "sources")
    upper, last = _tree(sources.select(F.lit("").alias("key"), "rank", F.col("of").alias("n"), F.col("subroot").alias("digest")))
    store = sources.select(F.col("subroot").alias("digest"), F.array("subroot").alias("children")).limit(0)
    for level in [*records, *upper]:
        store = store.union(level)
    found = last.first()
    return Manifest(written(store.dropDuplicates(["digest"]), "store"), leaves, sources, found.top if found else None)


def _segment(digit: Column) -> Column:
    left, right = F.slice("children", F.lit(1), digit), F.slice("children", digit + 2, F.lit(FAN))
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def _step(at: DataFrame, store: DataFrame, asked: DataFrame, key: list[str]) -> DataFrame:
    """One level down: ``at(*key, rank, digest, path, ...)`` to the children whose numbers ``asked(*key, rank)`` has."""
    size = F.lit(FAN).cast("long")
    digits = asked.groupBy(*key, _run(F.col("rank")).alias("rank")).agg(F.collect_set((F.col("rank") % size).cast("int")).alias("digits"))
    down = at.join(store, "digest").join(digits, [*key, "rank"]).withColumn("digit", F.explode("digits"))
    return down.select(*[c for c in at.columns if c not in ("rank", "digest", "path")], (F.col("rank") * size + F.col("digit")).alias("rank"),
                       F.element_at("children", F.col("digit") + 1).alias("digest"), F.array_append("path", _segment(F.col("digit"))).alias("path"))


def _levels(most: int) -> int:
    levels, size = 0, 1
    while size < most:
        levels, size = levels + 1, size * FAN
    return levels


def _ancestors(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("rank", _run(F.col("rank"), FAN ** levels)).distinct() if levels else nodes


def proofs(made: Manifest, requests: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, other, path) of each of ``requests``, rows of ``made.leaves``.

    ``path`` has one (left, right) per level from the leaf to the root: the digests, joined, before and after the node.
    """
    spark = made.store.sparkSession
    empty = "array<struct<left:string,right:string>>"
    wanted = requests.select("key").distinct().join(made.sources, "key")
    of = made.sources.agg(F.max("of")).first()[0] or 0
    at = spark.range(1 if made.root else 0).select(F.lit(0).cast("long").alias("rank"), F.lit(made.root).alias("digest"), F.array().cast(empty).alias("path"))
    for level in reversed(range(_levels(of))):
        at = written(_step(at, made.store, _ancestors(wanted.select("rank"), level), []), "descent")

    # At the subroots: on by the digits of the leaf's number.  A low tree is reached after fewer steps.
    at = (at.join(wanted.select("rank", "key", "n"), "rank").withColumns({"rank": F.lit(0).cast("long"), "subroot": F.col("digest")}))
    most = made.sources.agg(F.max("n")).first()[0] or 0
    for level in reversed(range(1, _levels(most))):
        ready = F.col("n") > FAN ** level
        asked = _ancestors(requests.where(ready).select("key", "rank"), level)
        at = written(_step(at.where(ready), made.store, asked, ["key"]).unionByName(at.where(~ready)), "descent")

    # The last step: a run's requests share its record, and each cuts its own path out of it.
    run = requests.withColumn("digit", (F.col("rank") % FAN).cast("int")).groupBy("key", _run(F.col("rank")).alias("rank")) \
        .agg(F.collect_list(F.struct("digit", "doc_id", "leaf", "other")).alias("asked"))
    low = at.where("n = 1").withColumn("children", F.array("digest"))
    high = at.where("n > 1").join(made.store, "digest")
    each = low.unionByName(high).join(run, ["key", "rank"]).withColumn("ask", F.explode("asked"))
    path = F.when(F.col("n") > 1, F.array_append("path", _segment(F.col("ask.digit")))).otherwise(F.col("path"))
    return each.select("ask.doc_id", "ask.leaf", "subroot", F.lit(made.root).alias("root"), "ask.other", F.reverse(path).alias("path"))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(path: Column, leaf: Column) -> Column:
    """The root that ``leaf`` and its path give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def verified(docs: DataFrame, other: Column | None = None) -> DataFrame:
    """Every row's proof, and the root that its leaf, or ``other`` in its place, folds to."""
    made = manifest(docs, other)
    shown = proofs(made, made.leaves).withColumn("folded_root", folded(F.col("path"), F.coalesce("other", "leaf")))
    return shown.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))
