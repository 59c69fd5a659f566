"""Learned operators: exact parts against brute force, learned parts on held-out rows."""

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import xxhash

from runlens.llm import language, mixing, quality_model, suffix_tree, toxicity
from runlens.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, score double, held_out string"


def rows_of(seed=1, n=300):
    rng = random.Random(seed)
    kinds = {"en": ["the", "of", "and", "thing", "shall", "with"], "de": ["der", "und", "nicht", "schön", "für", "ein"]}
    out = []
    for i in range(n):
        lang = rng.choice(list(kinds))
        words = [rng.choice(kinds[lang]) + rng.choice(["", "", "er", "en"]) for _ in range(rng.randint(5, 60))]
        bad, rude = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            words = [w.upper() + "!!" for w in words]
        if rude:
            words[rng.randrange(len(words))] = rng.choice(["blockhead", "blockheads", "nitwitted"])
        out.append((i, " ".join(words), lang, int(not bad), int(rude)))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(i, t, lang, "s", 0.0, "x") for i, t, lang, _, _ in rows]
                                 + [(900, None, "en", None, None, None), (901, "", None, None, None, None), (902, "12 !? 7", "en", "s", 0.0, None), (None, "the of", "en", None, None, None)], DOCS)
    labels = spark.createDataFrame([(i, q, t) for i, _, _, q, t in rows] + [(None, 1, 0), (5, None, None), (7777, 0, 1), (900, 1, 0)], "doc_id long, quality int, toxic int")
    return rows, docs.repartition(3), labels


def test_language(tables):
    rows, docs, _ = tables
    got = {r.doc_id: r for r in language.identify(docs, language.fit(docs), ["doc_id"]).collect()}
    test = [(i, lang) for i, _, lang, _, _ in rows if crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].lang_pred == lang for i, lang in test]) > 0.95
    assert got[900].lang_pred == got[901].lang_pred == got[902].lang_pred == "und" and got[900].score == 0.0 and got[900].rejected
    assert all(0 <= r.score <= 1 for r in got.values())


def test_quality(tables):
    rows, docs, labels = tables
    got = {r.doc_id: r.score for r in quality_model.score(docs, quality_model.fit(docs, labels), ["doc_id"]).collect()}
    test = [(i, q) for i, _, _, q, _ in rows if crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (q == 1) for i, q in test]) > 0.95
    assert len(got) == len(rows) + 4 and all(0 <= s <= 1 for s in got.values())


def test_toxicity(tables):
    rows, docs, labels = tables
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    test = [(i, t) for i, _, _, _, t in rows if crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (t == 1) for i, t in test]) > 0.95
    misspelt, quoted, plain = toxicity.probabilities(["you bl0ckhead", 'they said "blockhead" once', "you there"], model)
    assert misspelt > quoted and misspelt > plain


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_distances():
    rng = random.Random(1)
    terms = {"".join(rng.choice("abc") for _ in range(n)): rng.random() < 0.3 for n in (3, 4, 5, 5, 6, 8, 9, 10)}
    automaton = toxicity.Automaton(terms)
    for _ in range(3000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 11)))
        expected = {}
        for i, term in enumerate(automaton.terms):
            heads = [word[:n] for n in range(len(word) + 1)] if terms[term] else [word]
            d = min(levenshtein(term, h) for h in heads)
            if d <= toxicity.edits_allowed(term):
                expected[i] = d
        assert dict(automaton.matches(word)) == expected, word


def test_rare_toxicity(spark):
    """Five rows in ten thousand are toxic: all of them are read, and unseen ones are found."""
    rng = random.Random(2)
    common = [f"w{k}" for k in range(3000)]
    rows = []
    for i in range(10_000):
        words = [rng.choice(common) for _ in range(rng.randint(20, 60))]
        toxic = i % 2000 == 7
        if toxic:
            words[3] = rng.choice(["blockheads", "blockhead"])
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int"), rows=2000)
    assert any(t.startswith("block") for t in model.terms)
    clean, rude = toxicity.probabilities([" ".join(rng.choice(common) for _ in range(40)), "you blockhead " + rows[0][1]], model)
    assert clean < 0.01 and rude > 0.5, (clean, rude)


def test_quotations_are_found_in_the_whole_text():
    long = [f"w{k}" for k in range(60)]
    model = toxicity.Model({"blockhead": True}, {("blockhead", e): 8.0 for e in range(3)}, (1.0, -4.0))
    said = " ".join(["He", "told", '"you', *long[:30], "blockhead", *long[30:], 'all".', *long])
    plain = said.replace('"', "")
    unclosed = said.replace('all".', "all.")
    after = " ".join(['"a', 'quote"', *long, "blockhead", *long, '"another', 'one"'])
    german = " ".join(["„du", *long, "blockhead", *long, "du“"])
    found = toxicity.probabilities([said, plain, unclosed, after, german], model)
    assert (found >= 0.5).tolist() == [False, True, True, True, False]
    assert toxicity.quoted_words('a “b c” d «e» f "g" h "i j'.split()).tolist() == [False, True, True, False, True, False, True, False, False, False]


def test_toxicity_of_empty_and_long_texts(spark, tables):
    _, docs, labels = tables
    empty = docs.where("false")
    assert toxicity.score(empty, toxicity.fit(empty, labels), ["doc_id"]).count() == 0
    assert quality_model.score(empty, quality_model.fit(empty, labels.where("false")), ["doc_id"]).count() == 0
    model = toxicity.fit(docs, labels)
    text = "the of and thing " * 75_000
    p, q = toxicity.probabilities([text, text + " blockhead"], model)
    assert p < 0.5 < q


def test_without_labels(spark, tables):
    _, docs, labels = tables
    none = labels.where("false")
    assert {r.score for r in quality_model.score(docs, quality_model.fit(docs, none), ["doc_id"]).collect()} == {0.5}
    assert {round(r.score, 6) for r in toxicity.score(docs, toxicity.fit(docs, none), ["doc_id"]).collect()} == {0.5}
    empty = docs.where("false")
    assert language.identify(empty, language.fit(empty), ["doc_id"]).count() == 0


def test_base_score_and_tokens(tables):
    _, docs, _ = tables
    rows = docs.collect()
    tokens = lambda t: [bytes(w).lower() for w in (t or "").encode().split()] + [b"\n"]
    train = Counter(w for r in rows if r.doc_id is None or crc32(str(r.doc_id).encode()) % 10 for w in tokens(r.text))
    n, v = sum(train.values()), len(train)
    got = suffix_tree.suffix_tree_scores(docs).collect()
    assert len(got) == len(rows)
    text = {r.doc_id: r.text for r in rows}
    for r in got:
        own = tokens(text[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(train[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel=1e-9)
        assert r.score <= 0
    held = [r for r in got if r.held_out and r.n_tokens > 3]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_tree_is_a_distribution(spark, tables):
    """After any context the probabilities of all symbols add up to 1, and equal the definition's."""
    _, docs, _ = tables
    tree = suffix_tree.grow(suffix_tree.count(docs), least=1e-3)
    keys, _, _ = suffix_tree.spelled(["the of and", "schön"])
    for key in keys:
        context = key & ~np.uint64(255)
        p = tree.probabilities(np.sort(context | np.arange(256, dtype=np.uint64)))
        assert p.sum() == pytest.approx(1.0, abs=1e-9) and (p > 0).all()
    assert any(len(level.contexts) for level in tree.levels)


def test_suffix_tree_sees_six_symbols(spark):
    """The last letter of every word follows from the sixth symbol before it."""
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice(["xabcdep", "yabcdeq"]) for _ in range(40))
    got = suffix_tree.suffix_tree_scores(spark.createDataFrame([(i, text()) for i in range(400)], "doc_id long, text string"))
    held = [r.score for r in got.collect() if r.held_out]
    assert held and min(held) > -18  # 40 free choices of the first letter and the end; 12 more without the sixth symbol


def test_suffix_tree_without_training(spark):
    got = suffix_tree.suffix_tree_scores(spark.createDataFrame([], "doc_id long, text string"))
    assert got.count() == 0


def test_mixing_reaches_targets_and_optimum(tables):
    rows, docs, labels = tables
    named = labels.selectExpr("doc_id", "CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END AS domain")
    targets = {"bad": 0.1, "good": 0.9}
    got = mixing.mix(docs, named, targets).collect()
    assert len(got) == len(rows) + 4
    t = np.array([r.n_words for r in got], float)
    p = np.array([[r.p_bad, r.p_good] for r in got])
    rate = np.array([r.rate for r in got])
    assert np.abs(p.sum(axis=1) - 1).max() < 1e-9 and (rate >= 0).all()
    mass = (rate * t) @ p
    assert mass / mass.sum() == pytest.approx([0.1, 0.9], abs=0.01)
    # No small feasible move of a rate lowers the objective.
    d, s = t.sum(), (t @ p) / t.sum()
    goal = np.array([0.1, 0.9]) * min(s / np.array([0.1, 0.9]))
    grad = t / d * (p @ (((rate * t) @ p / d - goal) / s) + mixing.PULL * (rate - 1))
    assert np.abs(grad[rate > 1e-9]).max() * d / t.max() < 1e-6 and (grad[rate <= 1e-9] >= -1e-9).all()


def test_mixing_weights_and_posteriors_by_hand(tables):
    """Bucket weights from document counts, and the curve at its optimum."""
    rows, docs, labels = tables
    named = labels.selectExpr("doc_id", "CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END AS domain")
    known = {r.doc_id: r.domain for r in named.collect() if r.doc_id is not None and r.domain}
    signed = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)

    def bucket(kind, token):
        seed = xxhash.xxh64_intdigest(kind.encode(), 42)
        return signed(xxhash.xxh64_intdigest(token.encode(), seed)) % mixing.BUCKETS

    tokens = lambda t: [x for w in (t or "").split() for x in (bucket("word", w), bucket("beginning", w[:5].lower()), bucket("ending", w[-5:].lower()))]
    settles = lambda i: crc32(str(i).encode()) % mixing.SETTLING == 0
    text = {r.doc_id: r.text for r in docs.collect()}
    counts = {d: Counter() for d in ("bad", "good")}
    for t, d in {(text[i], d) for i, d in known.items() if i in text and not settles(i)}:
        counts[d].update(set(tokens(t)))
    n = {d: sum(c.values()) for d, c in counts.items()}

    def weight(d, b):
        expected = sum(c[b] for c in counts.values()) * n[d] / sum(n.values())
        return math.log((counts[d][b] + 1) / (expected + 1)) if abs(counts[d][b] - expected) > mixing.CHANCE * math.sqrt(expected + 1) else 0.0

    got = mixing.mix(docs, named, {"bad": 0.5, "good": 0.5}).collect()
    logit = {r.doc_id: math.log(r.p_bad / r.p_good) for r in got if 1e-9 < r.p_bad < 1 - 1e-9}
    some = list(logit)
    z = np.array([[sum(weight(d, b) for b in tokens(text[i])) / math.sqrt(len((text[i] or "").split()) + 1) for d in ("bad", "good")] + [1.0] for i in some])
    (bad, good, _), _, rank, _ = np.linalg.lstsq(z, np.array([logit[i] for i in some]), rcond=None)
    curve = np.linalg.lstsq(z, np.array([logit[i] for i in some]), rcond=None)[0]
    assert rank == 3 and bad > 0 > good and np.abs(z @ curve - np.array([logit[i] for i in some])).max() < 1e-6
    held = [i for i in known if i in text and settles(i)]
    p_bad = {r.doc_id: r.p_bad for r in got}
    mean = sum(p_bad[i] for i in held) / len(held)
    assert mean == pytest.approx(sum(known[i] == "bad" for i in held) / len(held), abs=0.01)


def test_mix_has_its_targets_in_held_out_labels(spark):
    """Words of the kept rows by their true labels, on rows whose labels nothing was learned from."""
    rng = random.Random(21)
    common = [f"word{k}" for k in range(800)]
    rude = [f"rude{k}x" for k in range(12)]
    rows = []
    for i in range(4000):
        kind = "toxic" if rng.random() < 0.12 else "poor" if rng.random() < 0.1 else "good"
        words = [rng.choice(common) for _ in range(rng.randint(60, 300))]
        if kind == "toxic":
            for _ in range(rng.randint(2, 5)):
                words[rng.randrange(len(words))] = rng.choice(rude) + rng.choice(["", "", "s", "!"])
        if kind == "poor":
            words = [w.upper() if rng.random() < 0.5 else w for w in words]
        rows.append((i, " ".join(words), kind, i < 2500))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, k) for i, _, k, shown in rows if shown], "doc_id long, domain string")
    targets = {"good": 0.97, "poor": 0.02, "toxic": 0.01}
    rate = {r.doc_id: r.rate for r in mixing.mix(docs, labels, targets, most=1.0).collect()}
    words = Counter()
    for i, text, kind, shown in rows:
        if not shown:
            words[kind] += rate[i] * len(text.split())
    total = sum(words.values())
    for kind, target in targets.items():
        odds = words[kind] / (total - words[kind]) / (target / (1 - target))
        assert 0.75 < odds < 1.35, (kind, words[kind] / total)


def test_mixed_documents(spark, tables):
    _, docs, labels = tables
    named = labels.selectExpr("doc_id", "CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END AS domain")
    kept = mixing.mixed_documents(docs, named, {"bad": 0.05, "good": 0.95}, most=1.0)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert mixing.mix(docs, named.where("false"), {"bad": 0.5, "good": 0.5}).where("rate <> 1").count() == 0
    assert mixing.mix(docs.where("false"), named, {"bad": 0.5, "good": 0.5}).count() == 0


def test_all_are_registered():
    import __spark_entry__

    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
