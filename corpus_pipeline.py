"""Corpus pipeline: STAGES applied in turn to `documents`.

Each stage's result is written as Parquet to the shared folder and read again as
the next one's input.
"""

from __future__ import annotations

from formloom.llm.common import read, stored
from formloom.llm.stages import mixing_stage, near_duplicate_stage, packing_stage, quality_stage, toxicity_stage

STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL cannot express the trained and iterative stages.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Rows of the last stage."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
