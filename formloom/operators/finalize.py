"""Final records with provenance, and their flat forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import newest
from .store import latest_reviews


def resolved(extractions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Extractions with `final_value` and `review_id` of the newest review:
    corrected value, null if rejected, else the value read."""
    last = latest_reviews(reviews.select("extraction_id", "review_id", "reviewed_at", "action", "corrected_value"))
    rows = extractions.join(last.select("extraction_id", "review_id", "action", "corrected_value"), "extraction_id", "left")
    value = F.when(F.col("action") == "correct", F.col("corrected_value")).when(F.col("action") == "reject", F.lit(None)).otherwise(F.col("value"))
    return rows.withColumn("final_value", value)


def final_fields(extractions: DataFrame, pages: DataFrame, reviews: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(fields, refused): a row (doc_id, field_name, final_value, extraction_id,
    review_id) for each field of the documents without open flags, the last page
    winning and `order` breaking ties; and the documents refused, with their
    number of open flags."""
    rows = resolved(extractions, reviews).join(pages.select("page_id", "doc_id", "page_no"), "page_id")
    refused = rows.where(F.col("flagged") & F.col("review_id").isNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_open"))
    best = newest(rows, ["doc_id", "field_name"], ["page_no", *order], ["final_value", "extraction_id", "review_id"])
    return best.join(refused.select("doc_id"), "doc_id", "left_anti"), refused


def records(fields: DataFrame, documents: DataFrame, finalized_at) -> DataFrame:
    """One record for each document: maps of values and provenance.  A document
    has as many fields as its schema declares."""
    entries = F.array_sort(F.collect_list(F.struct("field_name", F.col("final_value").alias("v"), F.struct("extraction_id", "review_id").alias("p"))))
    rows = fields.groupBy("doc_id").agg(entries.alias("e"))
    rows = rows.join(documents.select("doc_id", "schema_id"), "doc_id")
    return rows.select(
        F.substring(F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("schema_id"), finalized_at.cast("string")), 256), 1, 16).alias("record_id"),
        "doc_id",
        "schema_id",
        F.map_from_entries(F.transform("e", lambda x: F.struct(x["field_name"], x["v"]))).alias("final"),
        F.map_from_entries(F.transform("e", lambda x: F.struct(x["field_name"], x["p"]))).alias("provenance"),
        finalized_at.alias("finalized_at"),
    )


def final_json(final) -> Column:
    """{"field": value, ...} of a map of JSON texts, fields in the map's order."""
    pairs = F.transform(F.map_entries(final), lambda e: F.concat(F.lit('"'), F.replace(F.replace(e["key"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('": '), F.coalesce(e["value"], F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def cell(value) -> Column:
    """A JSON value as a flat cell: null empty, true and false capitalised,
    strings bare, lists and objects as JSON."""
    v = F.try_parse_json(value)
    kind = F.schema_of_variant(v)
    return (
        F.when(value.isNull() | F.is_variant_null(v), "")
        .when(kind == "BOOLEAN", F.initcap(F.try_variant_get(v, "$", "string")))
        .when(kind == "STRING", F.try_variant_get(v, "$", "string"))
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), value)
        .otherwise(F.trim(value))
    )


def field_order(recs: DataFrame) -> list[str]:
    """Field names in the order in which records, oldest first, show them; as
    many as schemas declare."""
    rows = recs.select("finalized_at", "record_id", F.posexplode(F.map_keys("final")).alias("pos", "field_name"))
    first = rows.groupBy("field_name").agg(F.min(F.struct("finalized_at", "record_id", "pos")).alias("at"))
    return [r.field_name for r in first.orderBy("at", "field_name").collect()]


def csv_rows(recs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Four fixed columns and a column for each field.  The map is read in
    place: no pivot, no shuffle."""
    names = names if names is not None else field_order(recs)
    return recs.select("record_id", "doc_id", "schema_id", "source_path", *[cell(F.try_element_at("final", F.lit(n))).alias(n) for n in names])


def jsonl_rows(recs: DataFrame) -> DataFrame:
    """One line for each record, the values nested as `fields`."""
    head = F.to_json(F.struct("record_id", "doc_id", "schema_id", "source_path", F.col("finalized_at").cast("string").alias("finalized_at")), {"ignoreNullFields": "false"})
    return recs.select("finalized_at", "record_id", F.concat(F.regexp_replace(head, r"\}$", ', "fields": '), final_json(F.col("final")), F.lit("}")).alias("value"))


def registry_rows(recs: DataFrame, field_map: dict[str, str], record_id_field: str = "record_id", skip_unmapped: bool = True, table_fields_as_json: bool = True) -> DataFrame:
    """(record_id, target, cell) of the registry import: names mapped, others
    left out if skip_unmapped (and there is a map) or kept, lists as JSON or
    left out."""
    rows = recs.select(F.col("record_id").alias(record_id_field), F.explode("final").alias("field_name", "value"))
    if field_map:
        target = F.try_element_at(F.create_map(*[F.lit(x) for kv in field_map.items() for x in kv]), F.col("field_name"))
    else:
        target = F.lit(None).cast("string")
    rows = rows.withColumn("target", target)
    if skip_unmapped and field_map:
        rows = rows.where("target IS NOT NULL")
    rows = rows.withColumn("target", F.coalesce("target", "field_name"))
    if not table_fields_as_json:
        kind = F.schema_of_variant(F.try_parse_json("value"))
        rows = rows.where(~F.coalesce(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.lit(False)))
    return rows.select(record_id_field, "target", cell(F.col("value")).alias("cell"))


def write_jsonl(recs: DataFrame, path: str) -> None:
    jsonl_rows(recs).repartitionByRange("finalized_at", "record_id").sortWithinPartitions("finalized_at", "record_id").select("value").write.text(path)


def write_csv(recs: DataFrame, path: str, names: list[str] | None = None) -> None:
    ordered = recs.repartitionByRange("finalized_at", "record_id").sortWithinPartitions("finalized_at", "record_id")
    csv_rows(ordered, names if names is not None else field_order(recs)).write.csv(path, header=True, quote='"', escape='"', emptyValue="")
