"""Quality classifier: naive Bayes support vectors.

Indicators of word n-grams and word-shape n-grams are scaled by the class
log-count ratios of a bounded labelled sample; a linear hinge-loss model is
fitted to them by dual coordinate descent, and its margins are turned into
probabilities on the same sample.  Every document is then scored in one pass
without a shuffle; the model (at most 2 * 2**bits floats) is all that is
broadcast.

Defined cases: null and empty texts get the score of a text without words; rows
without doc_id are scored, their `held_out` is null, and none is learnt from;
without labelled rows, or with one class only, the share of that class (0.5
for none) decides; repeated rows are scored alike; other columns play no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import Weights, fit_nbsvm, fit_platt, held_out, nbsvm_margins, of_documents, sample_matrix, scored, training_rows, word_shape_features

BITS = 18
#: Labelled rows that the model is fitted on, at most.
MAX_ROWS = 8000
#: Bytes of their texts, at most.
MAX_BYTES = 32 << 20


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, bits: int = BITS):
    """(weights, slope, shift); reads no row of the held-out fold."""
    features = word_shape_features(bits)
    bounds, feat, y = sample_matrix(training_rows(docs, labels, label, max_rows, max_bytes), features)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Weights.of(0.0, *np.zeros((2, 1 << bits))), 1.0, float(np.log(share / (1 - share)))
    model = fit_nbsvm(bounds, feat, y, bits)
    slope, shift = fit_platt(nbsvm_margins(model.dense(bits), model.bias, of_documents(bounds), feat, len(y)), y)
    return model, slope, shift


def score_quality(docs: DataFrame, fitted, bits: int = BITS, score: str = "score") -> DataFrame:
    model, slope, shift = fitted
    return scored(docs, word_shape_features(bits), nbsvm_margins, model, bits, slope, shift, score=score)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    fitted = fit_quality(docs, labels)
    rows = score_quality(docs.select("doc_id", "text"), fitted)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
