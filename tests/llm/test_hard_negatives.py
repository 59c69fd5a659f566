"""Hard negatives against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import hard_negatives
from runlens.llm.hard_negatives import cells_by_bound, hard_negatives as mine
from runlens.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, number int, group string, lane string"


def floors(v):
    return [int(np.floor(256 * x)) for x in v]


def brute(rows, divisor, positives=5, negatives=10):
    used = {(i, label, tuple(floors(v))) for i, v, label in rows
            if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in used:
        if i % divisor:
            continue
        scored = sorted((-score(v, w), j, other) for j, other, w in used if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k, _) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def table(seed, kind):
    rng = np.random.default_rng(seed)
    n, dim = (400, 8) if kind != "wide" else (150, 33)
    if kind == "clusters":
        v = rng.normal(size=(6, dim))[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * 0.05
    elif kind == "ties":
        v = rng.integers(-2, 3, (n, dim)).astype(float)
    else:
        v = rng.normal(size=(n, dim))
    if kind == "wide":
        v *= 1e6  # products beyond what doubles hold exactly
    if kind == "copies":
        v[: n // 2] = v[0]
    rows = [(int(i), [float(x) for x in row], int(rng.integers(0, 4))) for i, row in enumerate(v)]
    bad = [(None, [1.0] * dim, 1), (1000, None, 1), (1010, [None] + [1.0] * (dim - 1), 1), (1020, [float("nan")] * dim, 1), (1030, [float("inf")] * dim, 2),
           (1040, [1.0] * dim, None), (1050, [], 1), (1060, [0.5, -0.5], 2), (1070, [0.0] * dim, 3)]
    return rows + bad + rows[:3]


@pytest.mark.parametrize("kind", ["plain", "clusters", "ties", "copies", "wide"])
def test_against_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(hard_negatives, "SHARD", 37)
    monkeypatch.setattr(hard_negatives, "GROUP", 7)
    monkeypatch.setattr(hard_negatives, "VISIT", 8)
    rows = table(3, kind)
    df = spark.createDataFrame([(*r, 1, "g", "l") for r in rows], SCHEMA).repartition(3)
    found = mine(df, F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 10)


def test_visits_stop_early():
    """On clustered vectors most cells are never scored, and nothing is lost."""
    rng = np.random.default_rng(1)
    v = np.floor(256 * (rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.02))
    index = hard_negatives.Index([], 16)
    index.books = [hard_negatives.k_means(h, 24, s) for s, h in enumerate(index.halves(v))]
    codes = np.stack([hard_negatives.assigned(h, b) for h, b in zip(index.halves(v), index.books)], axis=1).astype(np.int32)
    index.radii = [np.array([np.sqrt(((h[c == w] - b[w]) ** 2).sum(axis=1)).max(initial=0.0) for w in range(len(b))])
                   for h, b, c in zip(index.halves(v), index.books, codes.T)]
    order = np.lexsort((codes[:, 1], codes[:, 0]))
    v, codes = v[order], codes[order]
    shard = hard_negatives.Shard(4000, 16, np.arange(4000).tobytes(), np.zeros(4000, np.int64).tobytes(), codes.tobytes(), v.tobytes())
    best = hard_negatives.Best(5)
    scored = hard_negatives.search(index, v[7], shard, lambda i, _, s: best.add(i, s), best.beaten)
    assert best.scores.tolist() == sorted((v @ v[7]).astype(int).tolist(), reverse=True)[:5]
    assert scored < 2500


def test_cells_come_by_falling_bound():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=9), rng.normal(size=5)
    seen = list(cells_by_bound(a, b))
    assert len({(i, j) for _, i, j in seen}) == 45 and [x[0] for x in seen] == sorted((x[0] for x in seen), reverse=True)
    assert list(cells_by_bound(a, b[:0])) == []


def test_query_and_empty(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)], i % 10) for i in range(250)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = QUERIES["op11_hard_negatives"](spark, str(tmp_path))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    relabelled = [(i, [float(np.float32(x)) for x in v], (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    assert sorted(tuple(r) for r in found.collect()) == brute(relabelled, 100)
    assert mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0], 1, 1, "g", "l")], SCHEMA)
    assert mine(one, F.col("vec_id") % 10 == 0).collect() == []


def test_copies_of_groups_are_never_broadcast(spark):
    packed = "number long, n int, ids binary, labels binary, v binary"
    one = bytearray(8)
    groups = spark.createDataFrame([(i, 1, one, one, one) for i in range(3)], packed)
    shards = spark.createDataFrame([(i, 1, one, one, one, one) for i in range(5)], f"{packed}, codes binary")
    pairs = hard_negatives.met(groups, shards, 4)
    assert sorted((r["group"], r["number"]) for r in pairs.collect()) == [(g, s) for g in range(3) for s in range(5)]
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
