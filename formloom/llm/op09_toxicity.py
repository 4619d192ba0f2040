"""Toxicity: FTRL-proximal logistic regression over hashed n-grams.

Words, their stems, neighbouring pairs and pairs with one word between are
hashed to 2**bits coordinates.  The model is fitted online, with a rate for each
coordinate and an L1 term that leaves most weights at zero, on a bounded labelled
sample.  The weights that are not zero (a few hundred of 2**bits) are broadcast
as pairs of index and weight; every document is scored in one pass without a
shuffle.

Defined cases: null and empty texts get the score of the bias alone; rows without
doc_id are scored, their `held_out` is null, and none is learnt from; without
labelled rows every score is 0.5; repeated rows are scored alike; other columns
play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import fit_ftrl, ftrl_margins, held_out, sample_matrix, scored, skip_gram_features, training_rows

BITS = 20
#: Labelled rows that the model is fitted on, at most.
MAX_ROWS = 10000
#: Bytes of their texts, at most.
MAX_BYTES = 32 << 20


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, bits: int = BITS):
    """Weights and bias; reads no row of the held-out fold."""
    return fit_ftrl(*sample_matrix(training_rows(docs, labels, label, max_rows, max_bytes), skip_gram_features(bits)), bits)


def score_toxicity(docs: DataFrame, weights, bits: int = BITS, score: str = "score") -> DataFrame:
    return scored(docs, skip_gram_features(bits), ftrl_margins, weights, bits, score=score)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    weights = fit_toxicity(docs, labels)
    rows = score_toxicity(docs.select("doc_id", "text"), weights)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
