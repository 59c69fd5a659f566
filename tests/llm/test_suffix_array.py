"""Repeated strings against a brute-force count of all strings."""

import random
from collections import Counter
from hashlib import sha256

import pytest

from runlens.llm import suffix_array


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    often = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if often[r[i:i + length]] > 1:
                gone[i:i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, sha256(kept).hexdigest()))
    return out


def made(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(rng.randint(10, 120)) for _ in range(6)]
    out = [None, "", "short", "x" * 199, "x" * 200, "x" * 201, "ab" * 300, "ab" * 250 + "c", "same " * 100, "same " * 100]
    for _ in range(n):
        t = prose(rng.randint(1, 150))
        for _ in range(rng.randint(0, 3)):
            s, at = rng.choice(shared), rng.randint(0, len(t))
            a = rng.randint(0, len(s) // 2)
            t = t[:at] + s[a:rng.randint(a, len(s))] + t[at:]
        out.append(t)
        if rng.random() < 0.4:  # a near copy
            b = list(t)
            for _ in range(rng.randint(0, 3)):
                b[rng.randrange(len(b))] = "Z"
            out.append("".join(b))
    return out


@pytest.mark.parametrize("seed,group", [(1, 1 << 14), (2, 3)])
def test_against_all_strings(spark, seed, group):
    texts = made(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, gram string").repartition(3)
    rows = suffix_array.without_repeats(docs, ["doc_id", "gram"], group=group).collect()
    expected = brute(texts, 200)
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id], texts[r.doc_id]


def test_texts_stay_whole(spark):
    passage = "é" * 150
    docs = spark.createDataFrame([(1, "a" + passage, "en"), (2, "b" + passage + "c", "de"), (3, None, None)], "doc_id long, text string, lang string")
    out = {r.doc_id: (r.text, r.lang) for r in suffix_array.deduplicated(docs).collect()}
    assert out == {1: ("a", "en"), 2: ("bc", "de"), 3: (None, None)}


def test_empty(spark):
    assert suffix_array.without_repeats(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0
