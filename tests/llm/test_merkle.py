"""The manifest against hashlib on small tables."""

from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from runlens.llm import merkle
from runlens.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, rank int, key string"


def h(s):
    return sha256(s.encode()).hexdigest()


def leaf(r, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))


def tree(nodes):
    """(root, proof, place of each level) of each node."""
    paths = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [nodes[i:i + 16] for i in range(0, len(nodes), 16)]
        for i, members in enumerate(under):
            run, digit = runs[i // 16], i % 16
            for m in members:
                paths[m].append((run[:digit], run[digit + 1:]))
        under = [sum(under[i:i + 16], []) for i in range(0, len(under), 16)]
        nodes = [h("".join(r)) for r in runs]
    return nodes[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    out, trees = [], []
    for s in order:
        kept = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees.append((kept, *tree([leaf(r, r[1]) for r in kept])))
    if not trees:
        return []
    root, tops = tree([t[1] for t in trees])
    for (kept, subroot, paths), top in zip(trees, tops):
        for r, path in zip(kept, paths):
            path = path + top
            at = own = leaf(r, r[1])
            if r[0] is not None and crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                at = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
            for left, right in path:
                at = h("".join(left) + at + "".join(right))
            out.append((r[0], own, subroot, root, h("".join("".join(x) + "".join(y) for x, y in path)), at, at == root))
    return sorted(out, key=str)


def table(sources, big):
    """Sources of sizes around the fan, nulls in every column, ties, very long texts."""
    rows, n = [], 0
    for s, size in sources:
        for _ in range(size):
            rows.append((n * 7919 % 100003, [f"Text {n} É", "", None, "ABC" * (400000 if big and n % 97 == 0 else 2)][n % 4], [None, "en"][n % 2], s, [n, None, -n][n % 3], "x", 1, "k"))
            n += 1
    rows += [(None, None, None, None, None, None, None, None), (5, "Tie", None, "s1", 1, "x", 1, "k"), (5, "Tie", None, "s1", 1, "x", 1, "k"), (5, "tie", None, "s1", 1, "x", 1, "k")]
    return rows


@pytest.mark.parametrize("sources", [[("s1", 1), ("s0", 16), ("Z", 17), ("", 33), (None, 2), ("é", 300)],
                                     [(f"s{i}", 1 + i % 3) for i in range(20)], [("s1", 0)]])
def test_against_hashlib(spark, tmp_path, sources):
    rows = table(sources, len(sources) == 6)
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["op13_merkle_manifest"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_requests_for_some_leaves(spark):
    docs = spark.createDataFrame(table([("a", 300), ("b", 40), ("c", 1)], False), SCHEMA)
    made = merkle.manifest(docs)
    some = merkle.proofs(made, made.leaves.where("rank % 50 = 3"))
    shown = some.withColumn("at", merkle.folded(F.col("path"), F.col("leaf"))).collect()
    assert len(shown) == made.leaves.where("rank % 50 = 3").count() == 7
    assert {r["at"] for r in shown} == {made.root}
    store = {r.digest: r.children for r in made.store.collect()}
    assert all(h("".join(c)) == d and 1 <= len(c) <= 16 for d, c in store.items()) and made.root in store


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(1, "a", None, None, None, None, None, None)], SCHEMA)
    r = merkle.verified(one).collect()[0]
    assert r.leaf == r.subroot == r.root == r.folded_root and r.verified and r.proof_sha256 == h("")
    assert merkle.verified(one.limit(0)).collect() == []
    assert merkle.manifest(one.limit(0)).root is None
