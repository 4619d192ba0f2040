"""One extraction batch: classify, scope, read, verify, apply rules.

Page types come first, as they decide which fields are read; then all fields are
read, and the rows kept, before rules look at them.  Each step is a set of joins and projections over the replies table (page_id, field_name,
source, role, text, latency_ms, model).  What a page already has under the same
version key is taken over, not read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import coerce
from ..functions.text import held
from ..plans.rules import failed_rules, flag_from_rules, names_in
from ..schema import FieldDef, Schema, field_defs
from . import store
from .extract import read_fields, values_agree, verified

TYPE_FIELD = "document_type"


def classified(pages: DataFrame, replies: DataFrame, schema: Schema, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(pages with their type, extraction rows of the type field).  A type that
    was read wins over the stored one, and that over the schema's default."""
    known = [f for f in schema.fields if f.name == TYPE_FIELD]
    if not known:
        kept = pages.withColumn("page_type", F.coalesce("page_type", F.lit(schema.default_page_type).cast("string")))
        return kept, read_fields(replies.limit(0), [FieldDef(TYPE_FIELD, "string")], threshold)
    own = replies.where((F.col("field_name") == TYPE_FIELD) & (F.col("source") == "page"))
    rows = read_fields(own, known, threshold).join(pages.select("page_id"), "page_id", "left_semi")
    read = rows.select("page_id", F.try_variant_get(F.try_parse_json("value"), "$", "string").alias("page_type"))
    return store.page_types(pages, read, schema.default_page_type), rows


def settled(df: DataFrame) -> DataFrame:
    """Computed once: a checkpoint where a folder for it is set, else a cached
    table.  What follows uses it several times."""
    sc = df.sparkSession.sparkContext
    if sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return df.checkpoint()
    return df.persist()


def read_needed(needs: DataFrame, replies: DataFrame, fields, threshold: float, crop_types: tuple[str, ...], verify: bool) -> DataFrame:
    """Rows of the needed (page_id, field_name, has_crop), all fields in one
    pass.  A field is read from its crop if it has one and its type is routed
    there."""
    routed = F.col("field_name").isin([f.name for f in fields if not crop_types or f.type in crop_types])
    wanted = needs.select("page_id", "field_name", (F.col("has_crop") & routed).alias("from_crop"))
    own = replies.join(wanted, ["page_id", "field_name"])
    source = F.when(F.col("from_crop"), "crop").otherwise("page")
    first = read_fields(own.where(F.col("source") == source).drop("from_crop"), fields, threshold).join(wanted, ["page_id", "field_name"])
    if not verify:
        return first.drop("from_crop")
    again = own.where("role = 'verify'").withColumn("role", F.lit("primary")).drop("from_crop")
    second = read_fields(again, fields, threshold).select("page_id", "field_name", "value", "raw_transcription", F.col("latency_ms").alias("_ms"))
    out = verified(first, second.drop("_ms"), values_agree(fields, "value", "verify_value"), F.col("from_crop"))
    out = out.join(second.select("page_id", "field_name", "_ms"), ["page_id", "field_name"], "left")
    took = F.when(~rows_flagged(out), F.coalesce("_ms", F.lit(0))).otherwise(0)
    return out.withColumn("latency_ms", F.col("latency_ms") + took).drop("from_crop", "_ms")


def rows_flagged(rows: DataFrame) -> Column:
    """Flags that were there before a second reading (those are not verified)."""
    return F.coalesce(F.col("flag_reason").isNotNull() & ~F.col("flag_reason").startswith("verify pass"), F.lit(False))


def extract_batch(
    pages: DataFrame,
    replies: DataFrame,
    schema: Schema,
    existing: DataFrame,
    version: str,
    at: Column,
    threshold: float = 0.85,
    crops: DataFrame | None = None,
    crop_types: tuple[str, ...] = (),
    verify: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(pages with types, new extraction rows) for pages (page_id, page_type).

    `existing` are extractions (page_id, field_name, value, prompt_version),
    `crops` the (page_id, field_name, region_id, crop_path) that were located.
    """
    spark = pages.sparkSession
    typed_pages, type_rows = classified(pages, replies, schema, threshold)
    typed_pages = settled(typed_pages)
    needs = store.in_scope(typed_pages, field_defs(spark, schema)).where(F.col("field_name") != TYPE_FIELD).select("page_id", "field_name")
    needs = store.not_done(needs, existing, version)
    if crops is None:
        crops = spark.createDataFrame([], "page_id string, field_name string, region_id string, crop_path string")
    needs = needs.join(crops.select("page_id", "field_name", F.lit(True).alias("has_crop")), ["page_id", "field_name"], "left").withColumn("has_crop", F.coalesce("has_crop", F.lit(False)))
    others = [f for f in schema.fields if f.name != TYPE_FIELD]
    rows = store.not_done(type_rows, existing, version)
    if others:
        rows = rows.unionByName(read_needed(needs, replies, others, threshold, crop_types, verify))
    rows = _with_rules(settled(rows), typed_pages, schema, existing, version)
    rows = rows.join(crops.select("page_id", "field_name", "region_id", "crop_path"), ["page_id", "field_name"], "left")
    key = F.substring(F.sha2(F.concat_ws(":", "page_id", "field_name", F.lit(version)), 256), 1, 16)
    return typed_pages, rows.select(key.alias("extraction_id"), "*", F.lit(version).alias("prompt_version"), at.alias("created_at"))


def _with_rules(rows: DataFrame, pages: DataFrame, schema: Schema, existing: DataFrame, version: str) -> DataFrame:
    """Rows with the flags of failed rules, page type by page type.  Records
    hold only the fields that rules name, those read before included."""
    named = [f for f in schema.fields if any(f.name in names_in(r.rule) for r in schema.rules)]
    if not named:
        return rows
    before = existing.where(F.col("prompt_version") == version).select("page_id", "field_name", "value")
    values = rows.select("page_id", "field_name", "value").unionByName(before)
    texts = values.groupBy("page_id").agg(*[F.max(F.when(F.col("field_name") == f.name, F.col("value"))).alias(f.name) for f in named])
    record = pages.select("page_id", "page_type").join(texts, "page_id", "left")
    record = record.select("page_id", "page_type", *[held(coerce(F.try_parse_json(f.name), f)).alias(f.name) for f in named])
    # Rules reckon in floating point; the readings keep their digits.
    plain = lambda f: F.col(f"{f.name}.value").cast("double") if f.type == "integer" else F.col(f"{f.name}.value")
    record = settled(record.select("page_id", "page_type", *[plain(f).alias(f.name) for f in named]))
    failures = None
    for kind in [*schema.page_types, None]:
        of_kind = record.where(F.col("page_type").isNull() if kind is None else F.col("page_type") == kind)
        part = failed_rules(of_kind, schema, kind, {f.name: F.col(f.name) for f in named}).select("page_id", "failed_rules")
        failures = part if failures is None else failures.unionByName(part)
    return flag_from_rules(rows, failures.where(F.size("failed_rules") > 0), ["page_id"])
