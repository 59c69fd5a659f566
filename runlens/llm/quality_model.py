"""Quality classifier: supervised subword embeddings with a softmax.

Defined cases: null and empty texts have no vectors and get the score of the
softmax's bias.  Repeated rows get equal scores.  Without labelled rows, or with one
class only, every score is the share of label 1 (0.5 without rows).  Null labels and
rows of ``labels`` without a document teach nothing; an id labelled twice teaches
twice.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, map_texts, whole_text
from .subword import Model, Shape, train

SAMPLE_ROWS = 2500
SHAPE = Shape(grams=(2, 3, 4), pairs=True)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, folds: int, rows: int) -> list[tuple[str, int]]:
    """At most ``rows`` (text, label) pairs of training ids; the ids are chosen without reading texts."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds))
    marked = F.broadcast(bounded_sample(marked.select("doc_id", F.col(label).alias("_label")), rows))  # at most ``rows`` pairs of numbers
    return [(r[0], r[1]) for r in docs.select("doc_id", whole_text().alias("_text")).join(marked, "doc_id").select("_text", "_label").collect()]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, rows: int = SAMPLE_ROWS, shape: Shape = SHAPE,
        **how) -> Model:
    pairs = sorted(labelled_texts(docs, labels, label, folds, rows))
    model = train([t for t, _ in pairs], [y for _, y in pairs], shape, **how)
    if len(model.classes) < 2:
        model.notes["constant"] = 0.5 if model.classes == [None] else float(model.classes[0])
    return model


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` and ``score``, the probability of label 1 of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x classes numbers

    def make(_, texts):
        m = shared.value
        if "constant" in m.notes:
            return {"score": pa.array(np.full(len(texts), m.notes["constant"]))}
        return {"score": pa.array(m.probabilities(texts)[:, m.classes.index(1)])}

    return map_texts(docs, make, "score double", keep)
