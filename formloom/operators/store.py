"""Queries and changes over the provenance tables.

Tables: documents (doc_id, file_hash, source_path, page_count, schema_id,
ingested_at, status), pages (page_id, doc_id, page_no, image_path, page_type),
regions (region_id, page_id, bbox), extractions (extraction_id, page_id,
field_name, value, flagged, ...), reviews (review_id, extraction_id, action,
corrected_value, reviewed_at), records (record_id, doc_id, schema_id, ...), meta
(key, value).  Changes return new tables; writers decide where they go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .latest import newest

_S, _L, _I, _D, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _table(*cols: tuple) -> T.StructType:
    return T.StructType([T.StructField(c[0], c[1], len(c) < 3) for c in cols])


#: The tables' columns; a third item marks those never null.
TABLES: dict[str, T.StructType] = {
    "meta": _table(("key", _S, 1), ("value", _S, 1)),
    "documents": _table(("doc_id", _S, 1), ("file_hash", _S, 1), ("source_path", _S, 1), ("page_count", _I, 1), ("schema_id", _S), ("ingested_at", _TS, 1), ("status", _S, 1)),
    "pages": _table(("page_id", _S, 1), ("doc_id", _S, 1), ("page_no", _I, 1), ("image_path", _S, 1), ("width_px", _I), ("height_px", _I), ("page_type", _S), ("deskew_angle", _D)),
    "regions": _table(("region_id", _S, 1), ("page_id", _S, 1), ("bbox", T.ArrayType(_I), 1), ("region_type", _S), ("is_handwritten", _I), ("reading_order", _I), ("layout_engine", _S, 1), ("engine_version", _S)),
    "extractions": _table(
        ("extraction_id", _S, 1), ("page_id", _S, 1), ("field_name", _S, 1), ("region_id", _S), ("crop_path", _S), ("value", _S), ("raw_transcription", _S), ("legible", _B), ("note", _S),
        ("model_confidence", _D), ("composite_confidence", _D), ("validation_status", _S, 1), ("validation_errors", T.ArrayType(_S)), ("flagged", _B, 1), ("flag_reason", _S),
        ("model_name", _S, 1), ("model_version", _S), ("prompt_version", _S, 1), ("latency_ms", _I), ("created_at", _TS, 1),
    ),
    "reviews": _table(("review_id", _S, 1), ("extraction_id", _S, 1), ("reviewer", _S, 1), ("action", _S, 1), ("corrected_value", _S), ("comment", _S), ("reviewed_at", _TS, 1)),
    "records": _table(("record_id", _S, 1), ("doc_id", _S, 1), ("schema_id", _S, 1), ("final_json", _S, 1), ("provenance", _S, 1), ("finalized_at", _TS, 1), ("exported_at", _TS), ("export_target", _S)),
}


# ---------------------------------------------------------------- reads

def review_queue(extractions: DataFrame, pages: DataFrame, reviews: DataFrame) -> DataFrame:
    """Flagged extractions without a review, with their page."""
    open_rows = extractions.where("flagged").join(reviews.select("extraction_id"), "extraction_id", "left_anti")
    return open_rows.join(pages.select("page_id", "doc_id", "page_no", *[c for c in ("image_path", "page_type") if c in pages.columns]), "page_id")


def queue_listing(queue: DataFrame, doc_id=None, field_name: str | None = None) -> DataFrame:
    if doc_id is not None:
        queue = queue.where(F.col("doc_id") == doc_id)
    if field_name is not None:
        queue = queue.where(F.col("field_name") == field_name)
    return queue.orderBy("doc_id", "page_no", "field_name")


def pages_to_extract(pages: DataFrame, documents: DataFrame, doc_id=None) -> DataFrame:
    """Pages of documents that did not fail, oldest document first."""
    docs = documents.where("status <> 'failed'")
    if doc_id is not None:
        docs = docs.where(F.col("doc_id") == doc_id)
    return pages.join(docs.select("doc_id", "schema_id", "ingested_at"), "doc_id").orderBy("ingested_at", "doc_id", "page_no")


def unresolved_flags(queue: DataFrame, doc_id=None) -> DataFrame:
    rows = queue if doc_id is None else queue.where(F.col("doc_id") == doc_id)
    return rows.select("doc_id", "field_name")


def records_to_export(records: DataFrame, documents: DataFrame, schema_id: str | None = None) -> DataFrame:
    """Records with their source; writers put them in order."""
    rows = records if schema_id is None else records.where(F.col("schema_id") == schema_id)
    return rows.join(documents.select("doc_id", "source_path"), "doc_id")


def not_done(needed: DataFrame, extractions: DataFrame, prompt_version: str) -> DataFrame:
    """Needed (page_id, field_name) that this prompt version has not read."""
    done = extractions.where(F.col("prompt_version") == prompt_version).select("page_id", "field_name")
    return needed.join(done, ["page_id", "field_name"], "left_anti")


def with_stored_values(needed: DataFrame, extractions: DataFrame, prompt_version: str) -> DataFrame:
    """Needed fields with the value already stored for this version, or null."""
    stored = extractions.where(F.col("prompt_version") == prompt_version).select("page_id", "field_name", F.col("value").alias("stored_value"))
    return needed.join(stored, ["page_id", "field_name"], "left")


def new_files(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Files whose content no document has; of equal files the first path."""
    first = files.groupBy("file_hash").agg(F.min("path").alias("path"))
    return first.join(documents.select("file_hash"), "file_hash", "left_anti")


def duplicate_files(files: DataFrame) -> DataFrame:
    return files.groupBy("file_hash").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("copies"))


def latest_reviews(reviews: DataFrame) -> DataFrame:
    return newest(reviews, ["extraction_id"], ["reviewed_at", "review_id"])


def item_detail(extractions: DataFrame, pages: DataFrame, regions: DataFrame, field_defs: DataFrame | None = None) -> DataFrame:
    rows = extractions.join(pages, "page_id").join(regions.select("region_id", "bbox"), "region_id", "left")
    return rows if field_defs is None else rows.join(F.broadcast(field_defs), "field_name", "left")


def page_fields(extractions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Extractions with the newest review's action."""
    last = latest_reviews(reviews.select("extraction_id", "review_id", "reviewed_at", "action"))
    return extractions.join(last.select("extraction_id", F.col("action").alias("review_action")), "extraction_id", "left")


def browse(extractions: DataFrame, pages: DataFrame, regions: DataFrame, reviews: DataFrame) -> DataFrame:
    return page_fields(extractions.join(pages.select("page_id", "doc_id", "page_no"), "page_id").join(regions.select("region_id", "bbox"), "region_id", "left"), reviews)


def image_of(crop_path: Column, image_path: Column) -> Column:
    """The crop, or the page where there is none."""
    return F.coalesce(F.nullif(crop_path, F.lit("")), image_path)


def schema_of(documents: DataFrame, doc_id) -> DataFrame:
    return documents.where(F.col("doc_id") == doc_id).select("doc_id", "schema_id")


def page_image(pages: DataFrame, page_id) -> DataFrame:
    return pages.where(F.col("page_id") == page_id).select("page_id", "image_path")


def extraction_image(extractions: DataFrame, pages: DataFrame, extraction_id) -> DataFrame:
    """The crop that an extraction was read from, or its page."""
    rows = extractions.where(F.col("extraction_id") == extraction_id).join(pages.select("page_id", "image_path"), "page_id")
    return rows.select("extraction_id", image_of(F.col("crop_path"), F.col("image_path")).alias("image"))


def review_target(extractions: DataFrame, pages: DataFrame, extraction_id) -> DataFrame:
    rows = extractions.where(F.col("extraction_id") == extraction_id).join(pages.select("page_id", "doc_id"), "page_id")
    return rows.select("extraction_id", "doc_id", "field_name")


def in_scope(pages: DataFrame, field_defs: DataFrame) -> DataFrame:
    """(page, field) pairs by page type: global fields and those of the type; all
    fields of pages without a type.  Declared fields are a few rows, so they
    become literals, and pages are read once with neither join nor shuffle."""
    names = field_defs.columns
    rows = field_defs.collect()
    kind = F.array(F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in field_defs.schema.fields]))

    def listed(keep) -> Column:
        kept = [F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in field_defs.schema.fields]) for r in rows if keep(r.field_page_type)]
        return F.array(*kept) if kept else F.slice(kind, 1, 0)

    fields = F.when(F.col("page_type").isNull(), listed(lambda t: True))
    for t in sorted({r.field_page_type for r in rows if r.field_page_type is not None}):
        fields = fields.when(F.col("page_type") == t, listed(lambda own, t=t: own in (None, t)))
    fields = fields.otherwise(listed(lambda own: own is None))
    return pages.withColumn("_d", F.explode(fields)).select(*pages.columns, *[F.col(f"_d.{n}").alias(n) for n in names])


def missing_fields(pages: DataFrame, field_defs: DataFrame, extractions: DataFrame) -> DataFrame:
    """Fields in scope of a page that have no extraction."""
    return in_scope(pages, field_defs).join(extractions.select("page_id", "field_name"), ["page_id", "field_name"], "left_anti")


# ---------------------------------------------------------------- counts

def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def documents_overview(documents: DataFrame, pages: DataFrame, extractions: DataFrame, queue: DataFrame) -> DataFrame:
    """Fields, flags (null without fields) and open flags of each document.
    Extractions are summed by page, then by document, before joining."""
    by_page = extractions.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("flagged").cast("long")).alias("f"))
    by_doc = pages.select("page_id", "doc_id").join(by_page, "page_id").groupBy("doc_id").agg(F.sum("n").alias("n_fields"), F.sum("f").alias("n_flagged"))
    waiting = queue.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_open"))
    rows = documents.join(by_doc, "doc_id", "left").join(waiting, "doc_id", "left")
    return rows.withColumn("n_fields", F.coalesce("n_fields", F.lit(0))).withColumn("n_open", F.coalesce("n_open", F.lit(0)))


def flagged_by_page(extractions: DataFrame) -> DataFrame:
    return extractions.groupBy("page_id").agg(F.count_if(F.col("flagged")).alias("n_flagged"), F.count(F.lit(1)).alias("n_fields"))


def outcomes(results: DataFrame) -> DataFrame:
    """Numbers and first error texts by outcome of an upload."""
    return results.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.min("detail").alias("example"))


def run_counters(events: DataFrame) -> DataFrame:
    kind = F.col("kind")
    return events.groupBy("run_id").agg(
        F.count_if(kind == "page").alias("pages_done"),
        F.count_if(kind == "field").alias("fields_done"),
        F.sum("flagged").alias("flagged"),
        F.count_if(kind == "failure").alias("failures"),
    )


def events_since(events: DataFrame, since: int) -> DataFrame:
    return events.where(F.col("seq") >= since).orderBy("seq")


# ---------------------------------------------------------------- changes

def page_types(pages: DataFrame, classified: DataFrame, default: str | None) -> DataFrame:
    """Pages with the type read now, else the one stored, else the default."""
    rows = pages.join(classified.select("page_id", F.nullif("page_type", F.lit("")).alias("_read")), "page_id", "left")
    return rows.withColumn("page_type", F.coalesce("_read", "page_type", F.lit(default).cast("string"))).drop("_read")


def mark_extracted(documents: DataFrame, done: DataFrame) -> DataFrame:
    """Documents among `done` go from ingested to extracted; other statuses stay."""
    rows = documents.join(done.select("doc_id").distinct().withColumn("_done", F.lit(True)), "doc_id", "left")
    return rows.withColumn("status", F.when(F.col("_done") & (F.col("status") == "ingested"), "extracted").otherwise(F.col("status"))).drop("_done")


def mark_exported(records: DataFrame, exported: DataFrame, target: str, at: Column) -> DataFrame:
    rows = records.join(exported.select("record_id").distinct().withColumn("_out", F.lit(True)), "record_id", "left")
    return (
        rows.withColumn("exported_at", F.when(F.col("_out"), at).otherwise(F.col("exported_at")))
        .withColumn("export_target", F.when(F.col("_out"), F.lit(target)).otherwise(F.col("export_target")))
        .drop("_out")
    )


def purge(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """All tables without the documents `doomed` and what belongs to them."""
    keys = doomed.select("doc_id").distinct()
    pages = tables["pages"].join(keys, "doc_id", "left_semi").select("page_id")
    extractions = tables["extractions"].join(pages, "page_id", "left_semi").select("extraction_id")
    out = dict(tables)
    for name in ("documents", "pages", "records"):
        out[name] = tables[name].join(keys, "doc_id", "left_anti")
    for name in ("extractions", "regions"):
        out[name] = tables[name].join(pages, "page_id", "left_anti")
    out["reviews"] = tables["reviews"].join(extractions, "extraction_id", "left_anti")
    return out


def upsert_meta(meta: DataFrame, changes: DataFrame) -> DataFrame:
    """A row for each key; a change's value wins."""
    rows = meta.select("key", "value", F.lit(0).alias("_at")).unionByName(changes.select("key", "value", F.lit(1).alias("_at")))
    return newest(rows, ["key"], ["_at", "value"], ["value"])


def append(table: str, rows: DataFrame, path: str) -> None:
    """Append rows to a stored table, in its columns and types; absent columns
    are null."""
    cols = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table]]
    rows.select(*cols).write.mode("append").parquet(f"{path}/{table}")


def replace(table: str, rows: DataFrame, path: str) -> None:
    """Put rows in the place of a stored table, which they may be made from: the
    new one is written in full before the old one goes."""
    spark = rows.sparkSession
    append(table, rows, f"{path}/next")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old = jvm.org.apache.hadoop.fs.Path(f"{path}/next/{table}"), jvm.org.apache.hadoop.fs.Path(f"{path}/{table}")
    place = old.getFileSystem(conf)
    place.delete(old, True)
    if not place.rename(new, old):
        raise OSError(f"{table} could not be put in place; it is at {path}/next")
