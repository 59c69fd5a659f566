"""Toxicity: a Levenshtein automaton intersected with a trie of toxic terms, and scores over context windows.

* The lexicon is learned: words and word beginnings (stems) that stand out in
  documents labelled toxic, from a bounded sample of labelled rows, half of it for each label, so that rare
  toxic rows are all read.  The curve below is put back to the labels' own shares.
* All terms live in one trie.  A state of the automaton is the set of (trie node,
  edits so far) that a word read so far can have reached; states and their steps
  are made when first needed and kept, so most words end in the dead state after a
  few letters.  A term of five letters or more may be one edit off, one of nine or more two.
* Every (term, edits) has a weight, the log odds of documents with such a hit; near
  spellings that clean documents hold too get none.
* A hit counts in its context: inside quotation marks, wherever in the text they open and close, or beside a word of
  reporting, it counts for a part of its weight only.  A logistic curve fitted on the
  sample turns a document's evidence into a probability.

Defined cases: null and empty texts have no hits and get the curve's lowest score.
Repeated rows get equal scores.  Without labelled rows, or without toxic ones, the lexicon is
empty and every score is the smoothed share of toxic rows.  Null labels teach
nothing.  Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, map_texts, whole_text
from .words import Coded, mixed

SAMPLE_ROWS = 5000
MAX_TERMS = 500
SHORTEST, LONGEST = 4, 12
REACH = 2  # words on each side of a hit among which words of reporting are looked for
QUOTED = 0.3  # part of its weight that a quoted hit keeps
MAX_STATES = 100_000

# Marks that open a quotation with those that close it, and words of reporting in the four languages.
MARKS = {'"': '"', "“": "”", "„": "“”", "”": "”", "«": "»", "»": "«", "‘": "’"}
REPORTING = frozenset("said says wrote quote quoted called sagte schrieb zitat dit écrit citation dijo escribió cita".split())


def bare(word: bytes) -> str:
    """The word in lower case without what stands around its letters."""
    w = word.decode("utf-8", "replace").lower()
    if w.isalpha():
        return w
    a, b = 0, len(w)
    while a < b and not w[a].isalnum():
        a += 1
    while b > a and not w[b - 1].isalnum():
        b -= 1
    return w[a:b]


def copy_groups(texts: list[str], bands: int = 12, rows: int = 4) -> np.ndarray:
    """A group number per document; documents that share a band of min-hashes of their word pairs are of one group.

    Copies of a text repeat its chance words, and must not count as several witnesses.
    """
    group = list(range(len(texts)))

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    first: dict[tuple, int] = {}
    seeds = mixed(np.arange(bands * rows, dtype=np.uint64) + np.uint64(1))
    for i, text in enumerate(texts):
        w = text.lower().encode("utf-8", "replace").split()
        h = np.array([crc32(b" ".join(pair)) for pair in {*zip(w, w[1:])}], np.uint64)
        if not len(h):
            continue
        least = mixed(h[:, None] + seeds).min(axis=0).reshape(bands, rows)
        for k in range(bands):
            other = root(first.setdefault((k, *least[k].tolist()), i))
            group[max(other, root(i))] = min(other, root(i))
    return np.array([root(i) for i in range(len(texts))])


def witnesses_asked(toxic_groups: int) -> int:
    """Copy groups that must hold a term: five, fewer where there are few toxic ones at all."""
    return max(2, min(5, toxic_groups // 10))


def learn_terms(texts: list[str], toxic: np.ndarray, share: float = 0.9, part: float = 0.01) -> dict[str, bool]:
    """term -> whether it is a stem that words go on from.

    A term is held by toxic documents of ``witnesses_asked`` copy groups and of ``part`` of all toxic ones, and at least ``share``
    of the groups that hold it are toxic.  Of nested candidates the one with the strongest evidence is kept, and
    the longest of those with the same.
    """
    words = [{bare(w) for w in set(t.encode("utf-8", "surrogatepass").split())} for t in texts]
    groups = copy_groups(texts)
    held: dict[bool, defaultdict[str, set]] = {True: defaultdict(set), False: defaultdict(set)}
    ends: defaultdict[str, set] = defaultdict(set)
    for own, bad, group in zip(words, toxic, groups.tolist()):
        for w in own:
            for n in range(SHORTEST, min(len(w), LONGEST) + 1):
                held[bool(bad)][w[:n]].add(group)
            if bad and SHORTEST <= len(w) <= LONGEST:
                ends[w].add(group)
    n1, n0 = (max(1, len(set(groups[toxic == y].tolist()))) for y in (1, 0))
    found, least = {}, witnesses_asked(n1)
    for term, witnesses in held[True].items():
        a, b = len(witnesses), len(held[False].get(term, ()))
        if a >= max(least, part * n1) and a >= share * (a + b):
            found[term] = a * np.log((a + 0.5) / (n1 + 1) * (n0 + 1) / (b + 0.5))
    kept: dict[str, bool] = {}
    for term in sorted(found, key=lambda t: (-round(found[t], 6), -len(t), t)):
        if len(kept) < MAX_TERMS and not any(term.startswith(k) or k.startswith(term) for k in kept):
            kept[term] = len(ends[term]) < 0.7 * len(held[True][term])
    return kept


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """Reads a word letter by letter and tells the (term, edits) it matches; built state by state when needed."""

    def __init__(self, terms: dict[str, bool]):
        self.terms = sorted(terms)
        self.stem = [terms[t] for t in self.terms]
        self.most = [edits_allowed(t) for t in self.terms]
        self.children: list[dict[str, int]] = [{}]
        self.ending: list[int] = [-1]
        self.reach = [0]  # most edits that a term below the node allows
        for i, term in enumerate(self.terms):
            node = 0
            self.reach[0] = max(self.reach[0], self.most[i])
            for ch in term:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.ending.append(-1)
                    self.reach.append(0)
                node = self.children[node][ch]
                self.reach[node] = max(self.reach[node], self.most[i])
            self.ending[node] = i
        self.clear()

    def clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.hits: list[tuple[tuple[int, int], ...]] = []
        self.dead = self.state(frozenset(), frozenset())
        self.start = self.state(self.closed({(0, 0)}), frozenset())

    def closed(self, places: set) -> frozenset:
        """With the letters of a term that a word may leave out."""
        todo = list(places)
        while todo:
            node, e = todo.pop()
            for child in self.children[node].values():
                if e < self.reach[child] and (child, e + 1) not in places:
                    places.add((child, e + 1))
                    todo.append((child, e + 1))
        return frozenset(places)

    def state(self, places: frozenset, passed: frozenset) -> int:
        """``passed``: (stem, edits) that the word has already gone through."""
        passed = set(passed)
        ended = set()
        for node, e in places:
            i = self.ending[node]
            if i >= 0 and e <= self.most[i]:
                (passed if self.stem[i] else ended).add((i, e))
        key = (places, frozenset(passed))
        if key not in self.ids:
            best: dict[int, int] = {}
            for i, e in passed | ended:
                best[i] = min(e, best.get(i, 9))
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.hits.append(tuple(sorted(best.items())))
        return self.ids[key]

    def step(self, at: int, ch: str) -> int:
        places, passed = self.sets[at]
        to = set()
        for node, e in places:
            child = self.children[node].get(ch)
            if child is not None:
                to.add((child, e))
            if e < self.reach[node]:
                to.add((node, e + 1))
                to.update((c, e + 1) for c in self.children[node].values() if e < self.reach[c])
        found = self.state(self.closed(to), passed)
        self.steps[at][ch] = found
        return found

    def matches(self, word: str) -> tuple[tuple[int, int], ...]:
        if len(self.sets) > MAX_STATES:
            self.clear()
        at, steps, dead = self.start, self.steps, self.dead
        for ch in word:
            known = steps[at].get(ch)
            at = self.step(at, ch) if known is None else known
            if at == dead:
                return ()
        return self.hits[at]


@dataclass
class Model:
    terms: dict[str, bool]
    weights: dict[tuple[str, int], float] = field(default_factory=dict)
    curve: tuple[float, float] = (0.0, 0.0)  # slope, intercept

    def automaton(self) -> Automaton:
        if "_automaton" not in self.__dict__:
            self.__dict__["_automaton"] = Automaton(self.terms)
        return self.__dict__["_automaton"]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}


def hits(texts: list[str], model: Model, weigh: bool = True) -> list[list[tuple[str, int, str, bool]]]:
    """Per text: (term, edits, word as written, quoted) of each hit, best term of a word only."""
    coded = Coded(texts)
    automaton = model.automaton()
    found: dict[int, tuple[str, int]] = {}
    for code, word in enumerate(coded.words):
        hit = automaton.matches(bare(word))
        if hit:
            scored = [(model.weights.get((automaton.terms[i], e), 0.0) if weigh else -e, automaton.terms[i], e) for i, e in hit]
            best = max(scored, key=lambda x: (x[0], -x[2], x[1]))
            if not weigh or best[0] > 0:
                found[code] = best[1:]
    out: list[list] = [[] for _ in texts]
    if not found:
        return out
    flag = np.zeros(len(coded.words), bool)
    flag[list(found)] = True
    ends = np.cumsum(coded.counts)
    places = np.flatnonzero(flag[coded.codes])
    last, words, quoted = -1, [], None
    for at in places:
        doc, code = int(coded.doc[at]), int(coded.codes[at])
        first = int(ends[doc] - coded.counts[doc])
        if doc != last:
            last, words = doc, [coded.words[c].decode("utf-8", "replace") for c in coded.codes[first:int(ends[doc])]]
            quoted = quoted_words(words)
        here = at - first
        out[doc].append((*found[code], words[here], bool(quoted[here]) or reported(words, here)))
    return out


def quoted_words(words: list[str]) -> np.ndarray:
    """Of each word of a text, whether quotation marks enclose it; marks that are never closed enclose nothing."""
    out = np.zeros(len(words), bool)
    closing, start = "", 0
    for i, word in enumerate(words):
        if word[0] in MARKS and (not closing or word[0] not in closing or word[0] == '"'):
            closing, start, word = MARKS[word[0]], i, word[1:]
        if closing:
            inner = word.rstrip(".,;:!?)")
            if inner[-1:] and inner[-1] in closing:
                out[start:i + 1] = True
                closing = ""
    return out


def reported(words: list[str], at: int) -> bool:
    """A word of reporting stands beside it."""
    return any(w.lower().strip(".,;:!?") in REPORTING for w in words[max(0, at - REACH):at + REACH + 1])


def evidence(found: list[tuple[str, int, str, bool]], model: Model) -> float:
    return sum(model.weights.get((t, e), 0.0) * (QUOTED if quoted else 1.0) for t, e, _, quoted in found)


def weigh(found: list[list], toxic: np.ndarray, n1: int, n0: int, terms: dict[str, bool], misspelt: float = 0.1) -> dict[tuple[str, int], float]:
    """Log odds of documents with a hit of (term, edits), never below 0.

    Exact hits elsewhere in a document don't speak for its near ones.  Before any is seen, near
    spellings are taken to be ``misspelt`` as frequent as the term; clean documents that hold one lower its weight.
    """
    counts: defaultdict = defaultdict(lambda: [0, 0])
    for hits_, bad in zip(found, toxic):
        least = min((e for _, e, _, _ in hits_), default=0)
        for t, e in {(t, e) for t, e, _, _ in hits_ if e == least}:
            counts[t, e][int(bad)] += 1
    out = {}
    for t in terms:
        for e in range(edits_allowed(t) + 1):
            b, a = counts[t, e]
            a += misspelt * counts[t, 0][1] if e else 0
            out[t, e] = max(0.0, float(np.log((a + 0.5) / (n1 + 1) * (n0 + 1) / (b + 0.5))))
    return out


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 100, ridge: float = 1e-3) -> tuple[float, float]:
    """Logistic regression of y on x by Newton's method."""
    w = np.zeros(2)
    a = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) / len(y) + ridge * w
        hess = (a * (p * (1 - p))[:, None]).T @ a / len(y) + ridge * np.eye(2)
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-10:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, rows: int = SAMPLE_ROWS) -> Model:
    """A model of at most ``rows`` labelled texts, half of them for each label; ids are chosen without reading texts."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds)).select("doc_id", "toxic")
    total = marked.agg(F.count_if(F.col("toxic") == 1), F.count("*")).first()
    chosen = [bounded_sample(marked.where(F.col("toxic") == y), rows // 2) for y in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most ``rows`` pairs of numbers
    pairs = sorted((r[0], r[1]) for r in docs.select("doc_id", whole_text().alias("_text")).join(few, "doc_id").select("_text", "toxic").collect())
    return fit_texts([t for t, _ in pairs], np.array([y for _, y in pairs], float), (total[0] + 0.5) / (total[1] + 1))


def fit_texts(texts: list[str], toxic: np.ndarray, share: float | None = None) -> Model:
    """``share`` is the part of toxic rows among all labelled ones, if it is not that of ``toxic``."""
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    own = (n1 + 0.5) / (n1 + n0 + 1)
    share = own if share is None else share
    flat = (0.0, float(np.log(share / (1 - share))))
    if not n1 or not n0:
        return Model({}, curve=flat)
    model = Model(learn_terms(texts, toxic))
    found = hits(texts, model, weigh=False)
    model.weights = weigh(found, toxic, n1, n0, model.terms)
    x = np.minimum([evidence(h, model) for h in hits(texts, model)], 20.0)
    if not model.terms:
        model.curve = flat
        return model
    slope, constant = fit_curve(x, toxic)
    model.curve = slope, constant + flat[1] - float(np.log(own / (1 - own)))
    return model


def probabilities(texts: list[str], model: Model) -> np.ndarray:
    x = np.minimum([evidence(h, model) for h in hits(texts, model)], 20.0)
    return 1.0 / (1.0 + np.exp(-(model.curve[0] * x + model.curve[1])))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep``, ``score`` and the hits of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_TERMS terms
    kind = pa.list_(pa.struct([("term", pa.string()), ("edits", pa.int32()), ("word", pa.string()), ("quoted", pa.bool_())]))

    def make(_, texts):
        m = shared.value
        found = hits(texts, m)
        x = np.minimum([evidence(h, m) for h in found], 20.0) if found else np.zeros(0)
        p = 1.0 / (1.0 + np.exp(-(m.curve[0] * x + m.curve[1])))
        rows = [[{"term": t, "edits": e, "word": w, "quoted": q} for t, e, w, q in h] for h in found]
        return {"score": pa.array(p), "hits": pa.array(rows, kind)}

    return map_texts(docs, make, "score double, hits array<struct<term: string, edits: int, word: string, quoted: boolean>>", keep)
