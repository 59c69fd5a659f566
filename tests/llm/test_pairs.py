"""Near-duplicates and nearest neighbours against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import minhash, neighbours
from runlens.llm.components import components


def shingled(text):
    words = (text or "").split()
    if not words:
        return None
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def jaccard(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys)


def classes(texts):
    sets = [shingled(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and jaccard(a, sets[j]) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def texts_with_copies(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    out = [None, "", " \n", "one two", "one two", "one two three", "er " * 200, "er " * 240, "er " * 300, "a b c d e f " * 30, "a b c d e f " * 33]
    for _ in range(40):
        base = [word() for _ in range(rng.randint(8, 300))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy  # chains
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_all_pairs(spark, seed):
    texts = texts_with_copies(seed)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, node int, digest string").repartition(3)
    rows = minhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in rows} == dict(enumerate(classes(texts)))
    assert sorted(r.doc_id for r in rows if r.is_kept) == sorted(set(classes(texts)))
    kept = minhash.deduplicated(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(classes(texts)))
    assert all(r.text == texts[r.doc_id] and r.digest == "x" for r in kept)


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(4)
    a = [f"w{rng.randint(0, 9)}" for _ in range(300)]
    b = a[:220] + [f"w{rng.randint(0, 9)}" for _ in range(80)]
    texts = [" ".join(a), " ".join(b)]
    doc, key, times, _ = minhash.shingles(texts)
    s = minhash.signatures(doc, key, times, 2, 4096)
    true = jaccard(shingled(texts[0]), shingled(texts[1]))
    assert abs((s[0] == s[1]).mean() - true) < 0.03
    assert abs(minhash.similarity(texts[:1], texts[1:])[0] - true) < 1e-12
    heavy = ["x y z v w " * 64, "x y z v w " * 40]
    doc, key, times, _ = minhash.shingles(heavy)
    s = minhash.signatures(doc, key, times, 2, 4096)
    assert abs((s[0] == s[1]).mean() - jaccard(shingled(heavy[0]), shingled(heavy[1]))) < 0.03


def test_repeated_rows_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(5, t), (5, t), (7, t), (None, t), (None, None), (9, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, -1 if r.class_id is None else r.class_id, r.is_kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [(False, 5, 5, True), (False, 5, 5, True), (False, 7, 5, False), (False, 9, 9, True), (True, 0, -1, True), (True, 0, 5, False)]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in minhash.deduplicated(docs).collect()) == [(False, 5), (False, 9), (True, 0)]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(none).count() == 0 and minhash.deduplicated(none).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest_rows(vectors, F.col("id") % 2 == 0, 3).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(50)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_neighbours_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((12, 24))
    x = centers[rng.integers(0, 12, 1500)] + 0.6 * rng.standard_normal((1500, 24))
    x[100:160] = x[100]  # a common vector
    rows = [(i, [float(v) for v in x[i].astype(np.float32)], "e") for i in range(1500)]
    rows += [(2000, None, ""), (2050, [0.0] * 24, ""), (2100, [float("nan")] * 24, ""), (2150, [None] * 24, ""), (2200, [1.0], ""), (None, rows[3][1], ""), (150, rows[150][1], "again")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node string").repartition(4)
    got = neighbours.nearest_rows(df, F.col("id") % 50 == 0, 5).collect()
    v = x.astype(np.float32).astype(float)
    sims = (v @ v.T) / np.sqrt((v * v).sum(1))[:, None] / np.sqrt((v * v).sum(1))
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
        assert abs(r.score - sims[r.query_id, r.vec_id]) < 1e-12
    hits = total = 0
    for q in range(0, 1500, 50):
        order = sorted((j for j in range(1500) if j != q), key=lambda j: (-round(sims[q, j], 12), j))[:5]
        hits += len(set(order) & {j for _, j in found[q]})
        total += 5
        assert sorted(k for k, _ in found[q]) == [1, 2, 3, 4, 5]
    assert set(found) == set(range(0, 1500, 50)) and hits / total >= 0.97
    assert [j for _, j in sorted(found[150])] == [100, 101, 102, 103, 104]


def recall(spark, x, k=5):
    """Part of the true neighbours that the answers name, by score."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in neighbours.nearest_rows(df, F.col("id") % 50 == 0, k).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = 0
    for q in range(0, len(x), 50):
        true = np.argsort(-neighbours.cosine(np.repeat(x[q:q + 1], len(x), axis=0), x), kind="stable")
        hits += len(set([int(j) for j in true if j != q][:k]) & set(got[q]))
    return hits / k / len(range(0, len(x), 50))


def test_neighbours_among_near_copies(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 64))
    x[:2000] = x[0] + 1e-3 * rng.standard_normal((2000, 64))  # cosines of about 1 - 1e-6
    assert recall(spark, x) >= 0.95


def test_beam_follows_recall(spark, monkeypatch):
    """Unclustered vectors and a graph of random links, which a narrow beam gets lost in."""
    def links(units, k):
        rng, nodes = np.random.default_rng(4), [r.node for r in units.select("node").orderBy("node").collect()]
        rows = [(a, nodes[j], 0.0, False) for a in nodes for j in rng.integers(0, len(nodes), 4).tolist()]
        return spark.createDataFrame(rows, "node long, other long, sim double, new boolean")

    monkeypatch.setattr(neighbours, "descent", links)
    monkeypatch.setattr(neighbours, "EXPANDED", 256)
    assert recall(spark, np.random.default_rng(3).standard_normal((2000, 64))) >= 0.9


def test_a_group_around_the_limit(spark):
    """2,000 texts of one family whose pairs lie between 0.7 and 0.9: classes equal those of all pairs."""
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    texts = []
    for i in range(2000):
        copy = list(base)
        for _ in range(rng.choice([2, 3, 4, 5, 6, 7, 8])):
            copy[rng.randrange(300)] = f"x{i}-{rng.randint(0, 10**6)}"
        texts.append(" ".join(copy))
    sets = [shingled(t) for t in texts]
    often = Counter(s for c in sets for s in c)
    index = {s: k for k, s in enumerate(s for s, n in often.items() if n > 1)}
    held = np.zeros((2000, len(index)), np.float32)
    for i, c in enumerate(sets):
        held[i, [index[s] for s in c if s in index]] = 1.0
    both = held @ held.T
    size = np.array([sum(c.values()) for c in sets], float)
    linked = (both / (size[:, None] + size - both) >= 0.8) | np.eye(2000, dtype=bool)
    root = np.arange(2000)
    while True:  # the least node that links lead to
        least = np.array([root[row].min() for row in linked])
        if (least == root).all():
            break
        root = least
    assert 100 < len(set(root)) < 1900 and (linked.sum() - 2000) / 2000**2 > 0.01
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()} == dict(enumerate(root.tolist()))


@pytest.mark.parametrize("block, tokens, slice_", [(3, 1 << 20, 50), (256, 900, 4096)])
def test_blocks_do_not_matter(spark, monkeypatch, block, tokens, slice_):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "TOKENS", tokens)
    monkeypatch.setattr(minhash, "SLICE", slice_)
    texts = texts_with_copies(5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()} == dict(enumerate(classes(texts)))


def test_very_long_texts_are_compared_whole(spark):
    rng = random.Random(12)
    long = [f"w{rng.randint(0, 10**6)}" for _ in range(200_000)]
    other = long[:190_000] + [f"y{k}" for k in range(10_000)]
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(long[100_000:]))], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
