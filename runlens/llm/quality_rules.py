"""Quality rules as weak supervision.

Every rule looks at counts of one whole text and votes good (1), bad (-1) or
abstains (0).  Nobody says which rule is right: the distinct vote patterns of all
documents, of which there are at most ``3 ** len(RULES)``, are counted by Spark,
and expectation-maximisation over the counted patterns estimates how often each
rule is right.  The posterior probability that a text is good follows from the
rules' accuracies and replaces all-must-pass filtering.

Defined cases: a null text has no words; it and every text that fails the base
rules are not kept.  Repeated rows are judged one by one and alike.  An empty table
gives an empty result (no EM is needed).  Other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .words import Coded, Spelled, encoded, mixed

WINDOW = 5
SYMBOLS = "#*$%&|<>"
_NOT_WORD = " \t\n\v\f\r"
_HAS_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")

COUNTS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "n_lines long, n_letter_words long, n_upper long, n_lower long, n_marks long, n_distinct long")

#: name, condition for a vote "bad", condition for a vote "good", over the counted columns
RULES: list[tuple[str, str, str]] = [
    ("length", "n_words < 10", "n_words >= 30"),
    ("symbols", "n_symbols > 0.1 * n_words", "n_symbols <= 0.01 * n_words"),
    ("repeated_words", "n_repeat_words > 0.2 * n_words", "n_repeat_words <= 0.05 * n_words"),
    ("repeated_lines", "n_dup_lines > 0.3 * n_lines", "n_lines >= 3 and n_dup_lines = 0"),
    ("word_length", "word_chars < 2.5 * n_words or word_chars > 12 * n_words", "word_chars between 3 * n_words and 10 * n_words"),
    ("letters", "n_letter_words < 0.7 * n_words", "n_letter_words >= 0.85 * n_words"),
    ("capitals", "n_upper > 0.4 * (n_upper + n_lower)", "n_upper <= 0.15 * (n_upper + n_lower) and n_lower > 0"),
    ("marks", "n_marks > 0.25 * n_words", "n_marks <= 0.05 * n_words"),
    ("variety", "n_words >= 50 and n_distinct < 0.1 * n_words", "n_distinct >= 0.3 * n_words"),
]

#: A rule's accuracy stays inside these bounds: better than chance, never beyond doubt.
LEAST, MOST = 0.55, 0.98


def repeated_places(coded: Coded, window: int = WINDOW) -> np.ndarray:
    """Marks the words that lie in a window of ``window`` words that its document holds twice or more.

    Windows are compared by a 64-bit hash of their words and their document.
    """
    marked = np.zeros(len(coded.codes), bool)
    size = len(coded.codes) - window + 1
    if size <= 1:
        return marked
    h = mixed(np.arange(len(coded.words), dtype=np.uint64) + np.uint64(1))[coded.codes]
    key = mixed(coded.doc[:size].astype(np.uint64) + np.uint64(7))
    for k in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[k:k + size]
    inside = np.flatnonzero(coded.doc[:size] == coded.doc[window - 1:])
    if not len(inside):
        return marked
    key = key[inside]
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    starts = inside[order[twice]]
    for k in range(window):
        marked[starts + k] = True
    return marked


def counted(texts: list[str]) -> dict[str, np.ndarray]:
    coded = Coded(texts)
    n = coded.docs
    per_doc = lambda mask: np.bincount(coded.doc, weights=mask, minlength=n).astype(np.int64) if len(coded.doc) else np.zeros(n, np.int64)
    spelled = Spelled(coded.words)
    letters = np.fromiter((bool(_HAS_LETTER.search(w)) for w in coded.words), bool, len(coded.words)) if spelled.n else np.zeros(0, bool)
    distinct = np.unique(coded.doc.astype(np.int64) * max(1, len(coded.words)) + coded.codes) // max(1, len(coded.words))
    out = {
        "n_words": coded.counts,
        "word_chars": np.fromiter((len(t) - sum(map(t.count, _NOT_WORD)) for t in texts), np.int64, n),
        "n_symbols": np.fromiter((sum(map(t.count, SYMBOLS)) for t in texts), np.int64, n),
        "n_repeat_words": per_doc(repeated_places(coded)),
        "n_letter_words": per_doc(letters[coded.codes]) if spelled.n else np.zeros(n, np.int64),
        "n_marks": np.fromiter((t.count("!") + t.count("?") for t in texts), np.int64, n),
        "n_distinct": np.bincount(distinct, minlength=n).astype(np.int64),
    }
    lines = [[x for x in encoded(t).split(b"\n") if x.strip()] for t in texts]  # bytes strip the same six characters
    out["n_lines"] = np.fromiter(map(len, lines), np.int64, n)
    out["n_dup_lines"] = np.fromiter((len(x) - len(set(x)) for x in lines), np.int64, n)
    raw = [np.frombuffer(encoded(t), np.uint8) for t in texts]
    out["n_upper"] = np.fromiter((np.count_nonzero((b - 65) < 26) for b in raw), np.int64, n)
    out["n_lower"] = np.fromiter((np.count_nonzero((b - 97) < 26) for b in raw), np.int64, n)
    return out


def text_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The counts that the rules read, per row of ``docs``."""
    names = [c.split()[0] for c in COUNTS.split(", ")]

    def make(_, texts):
        made = counted(texts)
        return {c: pa.array(made[c], pa.int64()) for c in names}

    return map_texts(docs, make, COUNTS, keep)


def votes() -> list[Column]:
    return [F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0).alias(f"vote_{name}") for name, bad, good in RULES]


def estimate(patterns: np.ndarray, weights: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> tuple[np.ndarray, float]:
    """Accuracy of every rule and the share of good texts, from counted vote patterns (rows of -1, 0, 1).

    One accuracy per rule; abstaining tells nothing.  The start is the majority's verdict.
    """
    weights = weights / weights.sum()
    good = 1.0 / (1.0 + np.exp(-patterns.sum(axis=1).astype(float)))
    accuracy, share = np.full(patterns.shape[1], 0.7), 0.5
    for _ in range(rounds):
        share = float(np.clip((weights * good).sum(), 0.5, 0.98))
        right = ((patterns == 1) * good[:, None] + (patterns == -1) * (1.0 - good)[:, None]) * weights[:, None]
        voted = ((patterns != 0) * weights[:, None]).sum(axis=0)
        before, accuracy = accuracy, np.clip((right.sum(axis=0) + 0.007) / (voted + 0.01), LEAST, MOST)
        good = posterior(patterns, accuracy, share)
        if np.abs(accuracy - before).max() < tolerance:
            break
    return accuracy, share


def posterior(patterns: np.ndarray, accuracy: np.ndarray, share: float) -> np.ndarray:
    z = np.log(share / (1.0 - share)) + patterns @ np.log(accuracy / (1.0 - accuracy))
    return 1.0 / (1.0 + np.exp(-z))


def fit(voted: DataFrame) -> tuple[np.ndarray, float]:
    """EM over the counted patterns of a table that has the ``vote_`` columns."""
    names = [f"vote_{r[0]}" for r in RULES]
    rows = voted.groupBy(*names).count().collect()  # at most 3 ** len(RULES) patterns
    if not rows:
        return np.full(len(RULES), 0.7), 0.5
    patterns = np.array([[r[n] for n in names] for r in rows])
    return estimate(patterns, np.array([r["count"] for r in rows], float))


def judge(voted: DataFrame, accuracy: np.ndarray, share: float) -> DataFrame:
    z = F.lit(float(np.log(share / (1.0 - share))))
    for (name, _, _), a in zip(RULES, accuracy):
        z = z + F.col(f"vote_{name}") * F.lit(float(np.log(a / (1.0 - a))))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (voted.withColumn("p_good", 1.0 / (1.0 + F.exp(-z)))
            .withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5)))


def quality_rules(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row: the counts, the votes, ``p_good``, ``base_failed`` and ``kept``.

    The counts are stored once; the EM and the verdicts read that small table.
    """
    from ..plans.scratch import written

    stored = written(text_counts(docs, [key]).select("*", *votes()), "votes")
    return judge(stored, *fit(stored))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Two scans: the first counts vote patterns, the second judges.  Nothing is shuffled
    but the counted patterns.
    """
    accuracy, share = fit(text_counts(docs, []).select(*votes()))
    rows = docs.select(F.struct("*").alias("_row"), "text")
    judged = judge(text_counts(rows, ["_row"]).select("*", *votes()), accuracy, share)
    return judged.where("kept").select("_row.*")
