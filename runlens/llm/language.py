"""Language identification: averaged hashed subword embeddings with a softmax, and calibrated rejection.

A prediction whose calibrated probability is under the model's limit is marked
``rejected``; the limit is the lowest at which the rest of the calibration rows is right
to the asked precision.

Defined cases: a null text or one without a letter is ``und`` with score 0 and
rejected.  Repeated rows get equal predictions.  Without training rows everything is
``und``; with one language every text with a letter gets it.  Rows with null lang teach
nothing.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, map_texts, whole_text
from .subword import Model, Shape, train

SAMPLE_ROWS = 2500
SHAPE = Shape(grams=(1, 2, 3), lower=False)
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def fit(docs: DataFrame, folds: int = 5, rows: int = SAMPLE_ROWS, shape: Shape = SHAPE, **how) -> Model:
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds))
    # The ids are ranked on two narrow columns; only the chosen rows' texts are read for good.
    pairs = sorted((r[0], r[1]) for r in bounded_sample(known.select("doc_id", whole_text().alias("_text"), "lang"), rows).select("_text", "lang").collect())
    return train([t for t, _ in pairs], [y for _, y in pairs], shape, **how)


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep``, ``lang_pred``, ``score`` and ``rejected`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(_, texts):
        m = shared.value
        p = m.probabilities(texts)
        best, top = p.argmax(axis=1), p.max(axis=1)
        known = np.fromiter((m.classes != [None] and _LETTER.search(t) is not None for t in texts), bool, len(texts))
        named = [m.classes[b] if ok else UNKNOWN for b, ok in zip(best, known)]
        score = np.where(known, top, 0.0)
        return {"lang_pred": pa.array(named, pa.string()), "score": pa.array(score), "rejected": pa.array(~known | (top < m.least))}

    return map_texts(docs, make, "lang_pred string, score double, rejected boolean", keep)
