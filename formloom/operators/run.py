"""A run: ask a model for what pages still need, and keep what it says.

Replies are written before anything is made of them, so a model is asked once
whatever is computed again.  A second run asks for nothing that the first one
kept under the same version key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsonrepair import is_object, parsed
from ..plans import prompts
from ..schema import Config, Schema, field_defs
from ..sources.completions import REPLY, Engine, ask
from . import store
from .batch import TYPE_FIELD, classified, extract_batch
from .extract import by_field, read_fields


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored table, empty if nothing was written yet."""
    try:
        return spark.read.schema(store.TABLES[name]).parquet(f"{path}/{name}")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], store.TABLES[name])
        raise


def requests(needs: DataFrame, schema: Schema, role: str, source: Column) -> DataFrame:
    """What to ask for the needed (page_id, field_name, image_path)."""
    def asked(fd):
        texts = (prompts.field_prompt(fd, schema), *([prompts.repair_prompt(fd)] if role == "retry" else []))
        return F.struct(F.lit("\n".join(texts)).alias("user"), F.lit(json.dumps(prompts.envelope_schema(fd))).alias("json_schema"))

    rows = needs.withColumn("_r", by_field(schema.fields, asked)).where("_r IS NOT NULL")
    return rows.select("page_id", "field_name", F.lit(role).alias("role"), source.alias("source"), "_r.user", "_r.json_schema", "image_path")


class Replies:
    """Replies of one run, kept as they come in below `path`."""

    def __init__(self, spark: SparkSession, path: str, make: Callable[[], Engine], allow_hosts: tuple[str, ...]):
        self.spark, self.path, self.make, self.allow_hosts = spark, f"{path}/replies/{uuid.uuid4().hex}", make, allow_hosts

    def ask(self, wanted: DataFrame, make: Callable[[], Engine] | None = None) -> DataFrame:
        ordered = wanted.repartition("page_id").sortWithinPartitions("page_id")
        path = f"{self.path}/{uuid.uuid4().hex}"
        ask(ordered, make or self.make, prompts.SYSTEM, self.allow_hosts).write.parquet(path)
        return self.spark.read.schema(REPLY).parquet(path)

    def with_retries(self, wanted: DataFrame, schema: Schema) -> DataFrame:
        """Replies, and those to a second question where no object came back."""
        first = self.ask(wanted)
        lost = parsed(first.where("error IS NULL"), "text", "_v").where(~is_object(F.col("_v"))).select("page_id", "field_name", "source")
        again = lost.join(wanted.select("page_id", "field_name", "image_path"), ["page_id", "field_name"])
        second = requests(again, schema, "retry", F.col("source"))
        return first if second.isEmpty() else first.unionByName(self.ask(second))


def run(
    spark: SparkSession,
    path: str,
    schema: Schema,
    config: Config,
    make: Callable[[], Engine],
    verifier: Callable[[], Engine] | None = None,
    doc_id=None,
    at: Column | None = None,
) -> DataFrame:
    """Read what the schema's pages below `path` still need, append the
    extractions, and give numbers by outcome.  Pages are read whole; a second
    model verifies accepted values where one is given."""
    at = F.current_timestamp() if at is None else at
    documents, pages, known = (table(spark, path, n) for n in ("documents", "pages", "extractions"))
    pages_now = store.pages_to_extract(pages, documents, doc_id).where(F.coalesce("schema_id", F.lit(schema.schema_id)) == schema.schema_id)
    pages_now = pages_now.select("page_id", "doc_id", "page_no", "image_path", "page_type")
    version = prompts.version_key(config.layout_engine, config.crop_field_types, config.verify_pass, config.verify_model)
    existing = known.select("page_id", "field_name", "value", "prompt_version")
    replies = Replies(spark, path, make, config.allow_hosts)
    page = F.lit("page")
    found = spark.createDataFrame([], REPLY)
    if any(f.name == TYPE_FIELD for f in schema.fields):
        first = store.not_done(pages_now.withColumn("field_name", F.lit(TYPE_FIELD)), existing, version)
        found = found.unionByName(replies.with_retries(requests(first, schema, "primary", page), schema))
    typed, _ = classified(pages_now, found, schema, config.review_threshold)
    needs = store.not_done(store.in_scope(typed, field_defs(spark, schema)).where(F.col("field_name") != TYPE_FIELD), existing, version)
    found = found.unionByName(replies.with_retries(requests(needs.select("page_id", "field_name", "image_path"), schema, "primary", page), schema))
    verify = config.verify_pass and verifier is not None
    if verify:
        read = read_fields(found.where(F.col("field_name") != TYPE_FIELD), schema.fields, config.review_threshold).where("NOT flagged AND value <> 'null'")
        sure = read.select("page_id", "field_name").join(pages_now.select("page_id", "image_path"), "page_id")
        found = found.unionByName(replies.ask(requests(sure, schema, "verify", page), verifier))
    typed, rows = extract_batch(pages_now, found, schema, existing, version, at, config.review_threshold, verify=verify)
    model = found.groupBy("page_id", "field_name").agg(F.max_by("model", F.col("role") == "primary").alias("model_name"))
    rows = rows.withColumnRenamed("composite", "composite_confidence").join(model, ["page_id", "field_name"], "left")
    rows = rows.withColumn("model_name", F.coalesce("model_name", F.lit("")))
    store.append("extractions", rows, path)
    kinds = typed.select("page_id", F.col("page_type").alias("_type"))
    store.replace("pages", pages.join(kinds, "page_id", "left").withColumn("page_type", F.coalesce("_type", "page_type")).drop("_type"), path)
    done = table(spark, path, "extractions").where(F.col("prompt_version") == version).join(table(spark, path, "pages"), "page_id").select("doc_id")
    store.replace("documents", store.mark_extracted(documents, done), path)
    kind = F.when(F.col("error").isNull(), F.concat(F.lit("asked as "), "role")).otherwise("failed")
    return store.outcomes(found.select(kind.alias("outcome"), F.col("error").alias("detail")))


def finalize_documents(spark: SparkSession, path: str, doc_id=None, at: Column | None = None) -> DataFrame:
    """Append the records of extracted documents without open flags, mark these
    as finalized, and give the documents that were refused."""
    from . import finalize

    at = F.current_timestamp() if at is None else at
    documents, pages, known, reviews = (table(spark, path, n) for n in ("documents", "pages", "extractions", "reviews"))
    now = documents.where("status <> 'finalized'")
    if doc_id is not None:
        now = now.where(F.col("doc_id") == doc_id)
    own = pages.join(now.select("doc_id"), "doc_id", "left_semi")
    fields, refused = finalize.final_fields(known, own, reviews, ["created_at", "extraction_id"])
    made = finalize.records(fields, documents.withColumn("schema_id", F.coalesce("schema_id", F.lit(""))), at)
    made = made.withColumn("final_json", finalize.final_json(F.col("final"))).withColumn("provenance", F.to_json("provenance"))
    refused = refused.persist()
    refused.count()  # before the tables it is made from are put in place anew
    store.append("records", made, path)
    done = table(spark, path, "records").select("doc_id").distinct().withColumn("_done", F.lit(True))
    status = F.when(F.col("_done"), "finalized").otherwise(F.col("status"))
    store.replace("documents", documents.join(done, "doc_id", "left").withColumn("status", status).drop("_done"), path)
    return refused
