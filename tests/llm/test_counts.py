"""Quality rules, packing and word helpers against brute force on small tables."""

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from runlens.llm import packing, quality_rules, suffix_tree
from runlens.llm.words import Coded, Spelled

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, open int"
TEXTS = [None, "", " \t\n", "one", "a b c d e f g h i j", "x y z w v x y z w v x y z w v q", "er " * 400, "l1 a\nl1 a\n\n \nl1 a\nl2",
         "| a | b & c <d>\n" * 5, "Ünï çödé   wörds here İstanbul ΣΑΣ é don't we'll 12 3", "same text again", "same text again",
         " ".join(f"w{i}" for i in range(9000)), "<|endoftext|> a <|startoftext|>", "\ud800".encode("utf-8", "replace").decode()]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, None, None, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "null id", None, None, None, None, None)], SCHEMA)


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    places = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(places))


def test_base_counts(docs):
    rows = quality_rules.quality_rules(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(TEXTS[r.doc_id])
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert not (r.base_failed and r.kept)


def test_em_finds_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(20000) < 0.8
    rates = np.array([0.95, 0.9, 0.8, 0.7])
    right = rng.random((20000, 4)) < rates
    votes = np.where(right == truth[:, None], 1, -1) * (rng.random((20000, 4)) < 0.9)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    accuracy, share = quality_rules.estimate(patterns, counts)
    assert np.abs(accuracy - rates).max() < 0.03 and abs(share - 0.8) < 0.03


def test_kept_documents_keep_all_columns(docs):
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {r.doc_id for r in quality_rules.quality_rules(docs).where("kept").collect()}


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], SCHEMA)
    assert quality_rules.quality_rules(none).count() == 0
    assert packing.pack(none, tokenizer()).count() == 0


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer())
    pieces = packing.pack(docs.repartition(5), tokenizer()).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == {*range(len(TEXTS)), None}
    for doc_id, own_pieces in by_doc.items():
        text = "null id" if doc_id is None else TEXTS[doc_id] or ""
        ids = [*own.encode(text, add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(own_pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == crc32(np.array(ids[at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for own_pieces in by_sequence.values():
        at = 0
        for p in sorted(own_pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.WINDOW


def test_packing_is_tight(spark):
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, "the " * int(n), "", "", 0, "", 0) for i, n in enumerate(rng.integers(1, 1500, 600))], SCHEMA).repartition(4)
    placed = packing.sequences(packing.pack(docs, tokenizer()))
    total = placed.selectExpr("sum(filled) AS f", "sum(padded) AS p").first()
    assert total.f / total.p > 0.95


def test_spelled_hashes_tell_words_apart():
    words = [b"a", b"b", b"ab", b"ba", b"abc" * 50, b"\x00", b"\x00\x00"]
    assert len(set(Spelled(words).hashes().tolist())) == len(words)
    assert Coded(["b a b", None or ""]).codes.tolist() == [0, 1, 0]


def test_counts_go_to_spark_in_small_batches():
    n = 2 * suffix_tree.SENT_ROWS + 7
    keys = np.arange(n, dtype=np.uint64)
    batches = list(suffix_tree.sent(1, (keys, np.ones(n, np.int64))))
    assert [b.num_rows for b in batches] == [suffix_tree.SENT_ROWS, suffix_tree.SENT_ROWS, 7]
    assert np.array_equal(np.concatenate([b.column("key").to_numpy() for b in batches]), keys.view(np.int64))


def test_ids_come_from_the_bytes_of_a_text():
    words = packing.Words(open(tokenizer(), encoding="utf-8").read())
    for text in [t or "" for t in TEXTS] + ["a\x1cb c\x85d e f\u3000g", "X.Y,,, ... ÀÉ! straße. É É é.", "\x0bA\x0cB\x1f x\x00y"]:
        assert words.ids(text.encode()) == np.array(words.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_a_place_is_searched_only_below_contexts_that_are_there(monkeypatch):
    rng = np.random.default_rng(2)
    places = np.sort(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) & (suffix_tree.mask(2) | np.uint64(255)))
    levels, searched = [], []
    for d in (1, 2):
        contexts = np.unique(places[:500 // d] & suffix_tree.mask(d))
        entries = np.unique(places[:500 // d] & (suffix_tree.mask(d) | np.uint64(255)))
        levels.append(suffix_tree.Level(contexts, rng.random(len(contexts)), entries, rng.random(len(entries))))
    tree = suffix_tree.Tree(np.full(256, 1 / 256), levels)
    want = []
    for key in places:
        p = 1 / 256
        for d, level in enumerate(levels, 1):
            where = np.flatnonzero(level.contexts == key & suffix_tree.mask(d))
            if len(where):
                here = level.share[level.entries == (key & (suffix_tree.mask(d) | np.uint64(255)))].sum()
                p = here + level.rest[where[0]] * p
        want.append(p)
    search = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda known, x, *a, **k: searched.append(len(x)) or search(known, x, *a, **k))
    assert tree.probabilities(places).tolist() == want
    assert sum(searched) < len(places)
