"""Repeated windows of words against a table of all windows."""

import random
import re
from hashlib import sha256

import pytest

from runlens.llm import block_repeats
from runlens.llm.block_repeats import without_repeats

SCHEMA = "doc_id long, text string, chunk string, place int, n_words string"


def brute(rows, window):
    """(doc_id, words, removed, kept) of each row; rows in the order of ids."""
    seen, out = set(), []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i:i + window])
            if w in seen:
                gone.update(range(i, i + window))
            seen.add(w)
        out.append((doc_id, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone), gone))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    prose = lambda n: [rng.choice(vocabulary) + str(rng.randint(0, 99)) for _ in range(n)]
    passages = [prose(n) for n in (19, 20, 21, 35, 60, 200)]
    texts = [None, "", " \n\t", "one", "ab " * 19, "ab " * 20, "ab " * 21, "ab " * 500, "x y " * 40, " ".join(passages[0]), " ".join(passages[1])]
    for _ in range(60):
        words = prose(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            words += rng.choice(passages) + prose(rng.choice([0, 1, 7, 30]))
        texts.append(rng.choice([" ", "  ", "\n", "   "]).join(words))
    texts += texts[20:26] + ["\r".join(passages[4]), "\x0b".join(passages[5] + passages[5])]
    return texts


@pytest.mark.parametrize("seed, window, block, limit", [(1, 20, 10, 4 << 20), (2, 20, 10, 700), (3, 7, 4, 300)])
def test_against_all_windows(spark, monkeypatch, seed, window, block, limit):
    monkeypatch.setattr(block_repeats, "CHUNK_BYTES", limit)
    texts = corpus(seed)
    rng = random.Random(seed)
    ids = rng.sample(range(-500, 500), len(texts))
    docs = spark.createDataFrame([(i, t, "c", 1, "n") for i, t in zip(ids, texts)], SCHEMA).repartition(3)
    found = {r.doc_id: r for r in without_repeats(docs, window, block, texts=True).collect()}
    assert len(found) == len(texts)
    for doc_id, n, removed, kept, gone in brute(sorted(zip(ids, texts)), window):
        r = found[doc_id]
        assert (r.n_words, r.n_removed, r.kept, r.kept_sha256) == (n, removed, kept, sha256(kept.encode()).hexdigest())
        assert {i for s in r.spans for i in range(s.start, s.end)} == gone
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_very_long_text_null_ids_and_repeated_rows(spark):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(300_000))
    again = long[1_000_000:1_002_000]
    rows = [(7, long, None, None, None), (8, again, None, None, None), (8, again, None, None, None), (None, again, None, None, None), (9, "q" * 2_000_000, None, None, None)]
    found = without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 5
    by = {i: sorted((r.n_words - r.n_removed for r in found if r.doc_id == i)) for i in (7, 8, 9, None)}
    edge = len(again.split())
    assert by[None] == [edge] and by[9] == [1]  # a null id comes first
    assert by[8] == [0, 0]
    assert 300_000 - edge <= by[7][0] <= 300_000 - edge + 2  # all but words that the cut of the passage broke


def test_empty(spark):
    assert without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        without_repeats(spark.createDataFrame([], SCHEMA), 18, 10)
