"""Documents as the mean of learned hashed vectors of words, character n-grams and word pairs, with a softmax on top.

Training is stochastic gradient descent in numpy on a bounded sample.  A trained
model is linear in its vectors, so scoring folds vectors and softmax weights into one
small table of logits per bucket: fixed by parameters, whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .words import Coded, Spelled, mixed

_WORD, _PAIR = np.uint64(0x51ED270B7A1F3C45), np.uint64(0x2545F4914F6CDD1D)


@dataclass(frozen=True)
class Shape:
    """What a document is made of and how large the model is."""

    buckets: int = 1 << 16
    dim: int = 16
    grams: tuple[int, ...] = (2, 3, 4)
    pairs: bool = False
    lower: bool = False

    def word_parts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word number, bucket) of every word's own bucket and n-grams, and the word hashes."""
        spelled = Spelled(words)
        own = spelled.hashes()
        at, keys = [np.arange(spelled.n, dtype=np.int32)], [mixed(own ^ _WORD)]
        for n in self.grams:
            w, h = spelled.grams(n)
            at.append(w)
            keys.append(h)
        bucket = (np.concatenate(keys) % np.uint64(self.buckets)).astype(np.int32)
        return np.concatenate(at), bucket, own

    def pair_buckets(self, coded: Coded, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, bucket) of each pair of neighbouring words; a word next to itself has one common bucket."""
        if not self.pairs or len(coded.codes) < 2:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        a, b, doc = coded.codes[:-1], coded.codes[1:], coded.doc[:-1]
        inside = doc == coded.doc[1:]
        h = mixed(own[a] * _PAIR + own[b])
        h[a == b] = _PAIR
        return doc[inside], (h[inside] % np.uint64(self.buckets)).astype(np.int32)


@dataclass
class Model:
    shape: Shape
    classes: list
    logits: np.ndarray  # buckets x classes
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0  # below this probability a prediction is rejected
    notes: dict = field(default_factory=dict)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        coded = Coded(texts, self.shape.lower)
        k, n = len(self.classes), coded.docs
        sums, parts = np.zeros((n, k)), np.zeros(n)
        if len(coded.codes):
            word, bucket, own = self.shape.word_parts(coded.words)
            per_word = np.bincount(word, minlength=len(coded.words)).astype(float)
            parts += np.bincount(coded.doc, weights=per_word[coded.codes], minlength=n)
            pair_doc, pair_bucket = self.shape.pair_buckets(coded, own)
            parts += np.bincount(pair_doc, minlength=n)
            for j in range(k):
                column = np.ascontiguousarray(self.logits[:, j])
                of_word = np.bincount(word, weights=column[bucket], minlength=len(coded.words))
                sums[:, j] += np.bincount(coded.doc, weights=of_word[coded.codes], minlength=n)
                if len(pair_doc):
                    sums[:, j] += np.bincount(pair_doc, weights=column[pair_bucket], minlength=n)
        z = sums / np.maximum(parts, 1.0)[:, None] + self.bias
        return softmax(z / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def parts_of(text: str, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets, share of the document's parts in each)."""
    coded = Coded([text], shape.lower)
    if not len(coded.codes):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    word, bucket, own = shape.word_parts(coded.words)
    times = np.bincount(coded.codes, minlength=len(coded.words)).astype(float)
    counts = np.bincount(bucket, weights=times[word], minlength=shape.buckets)
    counts += np.bincount(shape.pair_buckets(coded, own)[1], minlength=shape.buckets)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (counts[at] / counts.sum()).astype(np.float32)


def train(texts: list[str], labels: list, shape: Shape, epochs: int = 5, rate: float = 1.0, balance: float = 0.0, precision: float = 0.98,
          seed: int = 1) -> Model:
    """Fits vectors and softmax by SGD; a tenth of the sample sets the temperature and the rejection limit.

    ``balance`` (0 to 1) weighs classes by their rarity to that power.  One class or no
    rows give a constant model.
    """
    classes = sorted(set(labels))
    k = max(1, len(classes))
    if len(classes) < 2:
        return Model(shape, classes or [None], np.zeros((shape.buckets, k)), np.zeros(k))
    place = {c: i for i, c in enumerate(classes)}
    y = np.array([place[v] for v in labels])
    rng = np.random.default_rng(seed)
    docs = [parts_of(t, shape) for t in texts]
    order = rng.permutation(len(docs))
    aside, fitted = order[:len(docs) // 10], order[len(docs) // 10:]
    share = np.bincount(y, minlength=k) / len(y)
    weight = (1.0 / (k * np.maximum(share, 1e-9))) ** balance
    vectors = (rng.random((shape.buckets, shape.dim), np.float32) - 0.5) * (2.0 / shape.dim)
    out, bias = np.zeros((shape.dim, k), np.float32), np.zeros(k, np.float32)
    step, steps = 0, epochs * len(fitted)
    for _ in range(epochs):
        for i in rng.permutation(fitted):
            at, part = docs[i]
            lr = rate * (1.0 - step / steps)
            step += 1
            mean = part @ vectors[at] if len(at) else np.zeros(shape.dim, np.float32)
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            g = (p * (lr * weight[y[i]])).astype(np.float32)
            back = out @ g
            out -= np.outer(mean, g)
            bias -= 0.05 * g
            if len(at):
                # A mean hands each bucket only its share of the step; the norm makes the step independent of length.
                vectors[at] -= np.outer(part / np.sqrt(part @ part), back)
    model = Model(shape, classes, vectors.astype(float) @ out, bias.astype(float))
    calibrate(model, [docs[i] for i in aside], y[aside], precision)
    return model


def calibrate(model: Model, docs: list, y: np.ndarray, precision: float) -> None:
    """Temperature by least log loss; the rejection limit is the least probability at which ``precision`` of the rest is right."""
    if len(docs) < 20:
        return
    z = np.array([part.astype(float) @ model.logits[at] if len(at) else np.zeros(len(model.bias)) for at, part in docs]) + model.bias
    losses = []
    for t in (grid := np.geomspace(0.1, 10, 41)):
        p = softmax(z / t)[np.arange(len(y)), y]
        losses.append(-np.log(np.maximum(p, 1e-12)).mean())
    model.temperature = float(grid[int(np.argmin(losses))])
    p = softmax(z / model.temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-top)
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision
    model.least = float(top[order[np.flatnonzero(good).max()]]) if good.any() else 1.0
    model.notes = {"accuracy_aside": float(right.mean()), "aside": len(y)}
