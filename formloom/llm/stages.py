"""Pipeline stages: each takes (spark, docs, sf_dir) and returns a DataFrame.

All but packing return the columns of their input.  Rows without doc_id, and
null or empty texts, go through like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .common import free_name, read, stored
from .op03_jaccard_join import NO_ID, near_duplicate_rows
from .op05_quality import fit_quality, score_quality
from .op07_packing import pack_documents
from .op08_mixing import copies, fit_mixture, mixed, mixed_names
from .op09_toxicity import fit_toxicity, score_toxicity
from .queries import TARGETS, labelled_domains, public_path


def quality_stage(spark, docs: DataFrame, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Documents that the quality classifier accepts."""
    score = free_name(docs, "_score")
    scored = score_quality(docs, fit_quality(docs, read(spark, sf_dir, "labels")), score=score)
    return scored.where(F.col(score) >= threshold).drop(score)


def toxicity_stage(spark, docs: DataFrame, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    """Documents that the toxicity classifier does not mark."""
    score = free_name(docs, "_score")
    scored = score_toxicity(docs, fit_toxicity(docs, read(spark, sf_dir, "labels")), score=score)
    return scored.where(F.col(score) < threshold).drop(score)


def near_duplicate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest doc_id
    (null last) and, among equal ids, the smallest hash of its text.

    Rows are judged by their texts, not by their ids: unlike texts under one id
    all stay, and a row without doc_id goes if it is a copy.  Of rows that have
    the same id and text, one stays, whatever their other columns: that with the
    smallest hash over all columns.  Rows without words are linked with nothing
    and all stay.
    """
    judged = stored(near_duplicate_rows(docs).where("size > 0"), "judged")
    own = F.struct("id", "h")
    gone = judged.where(F.col("first") != own).select("id", "h").distinct()
    repeated = judged.where(F.col("first") == own).groupBy("id", "h").count().where("count > 1").select("id", "h")
    row, key_id, key_h = free_name(docs, "_row"), free_name(docs, "_id"), free_name(docs, "_h")
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias(row), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias(key_id), F.xxhash64(F.col("text").cast("string")).alias(key_h))
    named = lambda keys: keys.select(F.col("id").alias(key_id), F.col("h").alias(key_h))
    out = rows.join(named(gone), [key_id, key_h], "left_anti")
    if not repeated.isEmpty():
        twice = out.join(named(repeated), [key_id, key_h], "left_semi")
        hashed = [f"{row}.`{f.name}`" for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
        one = twice.groupBy(key_id, key_h).agg(F.min_by(F.col(row), F.xxhash64(*hashed)).alias(row))
        out = out.join(named(repeated), [key_id, key_h], "left_anti").unionByName(one)
    return out.select(f"{row}.*")


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the rates that mix domains to TARGETS: each is left out,
    kept or repeated so that its expected copies are its rate.  Rows with the
    same doc_id and text are treated alike."""
    domains, steps, _ = fit_mixture(docs, labelled_domains(docs, read(spark, sf_dir, "labels")), TARGETS)
    rows, (_, _, rate) = mixed(docs, domains, steps), mixed_names(docs)
    times = F.array_repeat(F.lit(1), copies(F.col(rate), "doc_id", "text").cast("int"))
    return rows.select(*docs.columns, F.explode(times).alias(free_name(docs, "_copy"))).select(*docs.columns)


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return pack_documents(docs, public_path("word_bpe_49k.json"))
