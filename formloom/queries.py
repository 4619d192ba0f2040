"""Queries over the driver's tables, each with DuckDB SQL for the same rows.

A query is built from the package's operators on the projections of
`fixtures.py`; its SQL is written apart, as plain statements.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fixtures import ctes, load
from .functions import coerce as co
from .functions import score
from .functions.compare import numbers_match, values_match
from .functions.jsonrepair import envelope, is_object, parsed
from .functions.text import comparison_form, first_word, held, pair_id, percent, token_set
from .operators import evaluate, finalize, invariants, store
from .operators.latest import newest
from .plans.rules import failed_rules
from .schema import FieldDef, Rule, Schema

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *projections: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = (ctes(*projections) if projections else "") + sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _many(spark, d, *names):
    return [load(spark, d, n) for n in names]


_NEWEST = """SELECT *, row_number() OVER (PARTITION BY page_id, field_name ORDER BY created_at DESC, extraction_id DESC) AS rn FROM fx_extractions"""
_QUEUE = """SELECT e.*, p.doc_id, p.page_no, p.page_type FROM fx_extractions e JOIN fx_pages p USING (page_id)
    WHERE e.flagged AND NOT EXISTS (SELECT 1 FROM fx_reviews r WHERE r.extraction_id = e.extraction_id)"""
_LAST_REVIEW = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY extraction_id ORDER BY reviewed_at DESC, review_id DESC) AS rn FROM fx_reviews) t WHERE rn = 1"""


# ---------------------------------------------------------------- scores

def _judged(spark, d):
    gold, ext = _many(spark, d, "gold", "extractions")
    got = evaluate.newest_readings(ext.select("page_id", "field_name", "created_at", "extraction_id", "value", "legible", "flagged"), ["page_id", "field_name"], ["created_at", "extraction_id"])
    return evaluate.judged(gold, got, ["page_id", "field_name"], numbers_match(F.col("value"), F.col("gold_value")))


_JUDGED = f"""j AS (SELECT g.page_id, g.field_name, g.gold_value, x.value, x.flagged, x.legible, x.extraction_id IS NOT NULL AS found,
    CASE WHEN x.value IS NULL OR g.gold_value IS NULL THEN x.value IS NULL AND g.gold_value IS NULL ELSE abs(CAST(x.value AS DOUBLE) - g.gold_value) < 1e-9 END AS ok
    FROM fx_gold g LEFT JOIN (SELECT * FROM ({_NEWEST}) t WHERE rn = 1) x USING (page_id, field_name))"""
_COUNTS = """count(*) AS n, count(*) FILTER (ok) AS correct, count(*) FILTER (flagged) AS flagged, count(*) FILTER (NOT flagged) AS auto_accepted,
    count(*) FILTER (NOT flagged AND ok) AS auto_accepted_correct, count(*) FILTER (NOT flagged AND NOT ok) AS false_negative_flags,
    count(*) FILTER (gold_value IS NULL) AS halluc_opportunities, count(*) FILTER (gold_value IS NULL AND value IS NOT NULL AND legible) AS hallucinations,
    count(*) FILTER (gold_value IS NULL AND value IS NOT NULL AND legible AND NOT flagged) AS hallucinations_escaped"""


_REPORT = (
    ("exact", "correct", "n"), ("auto_acc", "auto_accepted_correct", "auto_accepted"), ("flags", "flagged", "n"), ("fn_flags", "false_negative_flags", "auto_accepted"),
    ("halluc", "hallucinations", "halluc_opportunities"), ("halluc_esc", "hallucinations_escaped", "halluc_opportunities"),
)


@query(f", {_JUDGED} SELECT coalesce(field_name, '(all)') AS field_name, {_COUNTS} FROM j WHERE found GROUP BY ROLLUP (field_name)", "gold", "extractions")
def scorecard(spark, d):
    """TOP1 J8 CMP1 AGG4 AGG5: counters by field and over all."""
    return evaluate.scorecard(_judged(spark, d)).withColumn("field_name", F.coalesce("field_name", F.lit("(all)")))


@query(
    f""", {_JUDGED}, s AS (SELECT coalesce(field_name, '(all)') AS field_name, {_COUNTS} FROM j WHERE found GROUP BY ROLLUP (field_name))
    SELECT field_name, round(correct / n, 6) AS exact, round(auto_accepted_correct / nullif(auto_accepted, 0), 6) AS auto_accuracy, round(flagged / n, 6) AS flag_rate,
    round(false_negative_flags / nullif(auto_accepted, 0), 6) AS fn_flag_rate, round(hallucinations / nullif(halluc_opportunities, 0), 6) AS halluc_rate,
    round(hallucinations_escaped / nullif(halluc_opportunities, 0), 6) AS halluc_escaped_rate FROM s""",
    "gold", "extractions",
)
def score_ratios(spark, d):
    """AGG6."""
    names = ["exact", "auto_accuracy", "flag_rate", "fn_flag_rate", "halluc_rate", "halluc_escaped_rate"]
    return evaluate.ratios(scorecard(spark, d)).select("field_name", *[F.round(n, 6).alias(n) for n in names])


@query(
    f""", {_JUDGED}, s AS (SELECT coalesce(field_name, '(all)') AS field_name, {_COUNTS} FROM j WHERE found GROUP BY ROLLUP (field_name)) SELECT field_name, n, """
    + ", ".join(f"CASE WHEN {d} = 0 THEN '-' ELSE CAST(CAST(round_even(100.0 * {n} / {d}, 0) AS INT) AS STRING) || '%' END AS {c}" for c, n, d in _REPORT)
    + " FROM s",
    "gold", "extractions",
)
def report_rows(spark, d):
    """SNK6: the report's percentages."""
    return scorecard(spark, d).select("field_name", "n", *[percent(F.col(n), F.col(den)).alias(c) for c, n, den in _REPORT])


@query(
    """SELECT g.page_id, g.field_name FROM fx_gold g WHERE NOT EXISTS (SELECT 1 FROM fx_extractions e WHERE e.page_id = g.page_id AND e.field_name = g.field_name AND e.prompt_version = 'v1')""",
    "gold", "extractions",
)
def missing_gold_fields(spark, d):
    """AGG7: gold without a reading by one prompt version."""
    gold, ext = _many(spark, d, "gold", "extractions")
    rows = evaluate.judged(gold, ext.where("prompt_version = 'v1'").select("page_id", "field_name").distinct(), ["page_id", "field_name"], F.lit(True))
    return rows.where("NOT found").select("page_id", "field_name")


@query("SELECT count(*) AS n, count(*) FILTER (gold_value IS NULL) AS n_null FROM fx_gold", "gold")
def gold_null_share(spark, d):
    """AGG11."""
    return evaluate.null_share(load(spark, d, "gold"), "gold_value")


@query(
    """, d AS (SELECT doc_id, regexp_extract(source_path, '^([A-Z]+_[0-9]+)', 1) AS pair_id, ingested_at FROM fx_documents)
    SELECT pair_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY ingested_at DESC, doc_id DESC) AS rn FROM d) t WHERE rn = 1""",
    "documents",
)
def pair_documents(spark, d):
    """PRJ15 TOP4 J7: newest document of each pair id."""
    return evaluate.pair_documents(load(spark, d, "documents"), pair_id(F.col("source_path")))


# ---------------------------------------------------------------- review

@query(f", q AS ({_QUEUE}) SELECT extraction_id, doc_id, page_no, field_name FROM q", "extractions", "pages", "reviews")
def review_queue(spark, d):
    """PRJ1 J1 J6."""
    return store.review_queue(*_many(spark, d, "extractions", "pages", "reviews")).select("extraction_id", "doc_id", "page_no", "field_name")


@query(
    f""", q AS ({_QUEUE}) SELECT extraction_id, doc_id, page_no, field_name, dense_rank() OVER (ORDER BY doc_id, page_no, field_name) AS place FROM q WHERE doc_id = 13""",
    "extractions", "pages", "reviews",
)
def queue_listing(spark, d):
    """PRJ2 SRT1: a document's queue; place is the position among its keys in
    the order in which rows come."""
    rows = store.queue_listing(review_queue(spark, d), 13).withColumn("at", F.monotonically_increasing_id())
    key = F.struct("doc_id", "page_no", "field_name")
    # One document's rows.
    turns = rows.withColumn("new", (~F.lag(key).over(Window.orderBy("at")).eqNullSafe(key)).cast("long"))
    return turns.select("extraction_id", "doc_id", "page_no", "field_name", F.sum("new").over(Window.orderBy("at")).alias("place"))


@query(f", q AS ({_QUEUE}) SELECT extraction_id, doc_id, page_no, field_name FROM q WHERE field_name = 'f2' AND doc_id = 13", "extractions", "pages", "reviews")
def queue_of_field(spark, d):
    """PRJ2: both predicates."""
    return store.queue_listing(review_queue(spark, d), 13, "f2").select("extraction_id", "doc_id", "page_no", "field_name")


@query(f", q AS ({_QUEUE}) SELECT doc_id, field_name, count(*) AS n FROM q GROUP BY ALL", "extractions", "pages", "reviews")
def unresolved_flags(spark, d):
    """PRJ4 AGG3."""
    return store.unresolved_flags(review_queue(spark, d)).groupBy("doc_id", "field_name").agg(F.count(F.lit(1)).alias("n"))


@query(f", l AS ({_LAST_REVIEW}) SELECT extraction_id, review_id, action, corrected_value FROM l", "reviews")
def latest_review(spark, d):
    """TOP2."""
    return store.latest_reviews(load(spark, d, "reviews")).select("extraction_id", "review_id", "action", "corrected_value")


@query(
    f""", l AS ({_LAST_REVIEW}) SELECT e.extraction_id, e.field_name, l.action AS review_action FROM fx_extractions e LEFT JOIN l USING (extraction_id)""",
    "extractions", "reviews",
)
def page_fields(spark, d):
    """PRJ10."""
    return store.page_fields(*_many(spark, d, "extractions", "reviews")).select("extraction_id", "field_name", "review_action")


@query(
    f""", l AS ({_LAST_REVIEW}) SELECT e.extraction_id, p.doc_id, p.page_no, r.x0, r.y0, l.action AS review_action
    FROM fx_extractions e JOIN fx_pages p USING (page_id) LEFT JOIN fx_regions r ON e.region_id = r.region_id LEFT JOIN l ON l.extraction_id = e.extraction_id""",
    "extractions", "pages", "regions", "reviews",
)
def browse_extractions(spark, d):
    """PRJ11 J4."""
    ext, pages, regions, reviews = _many(spark, d, "extractions", "pages", "regions", "reviews")
    rows = store.browse(ext, pages, regions.withColumn("bbox", F.array("x0", "y0")), reviews)
    return rows.select("extraction_id", "doc_id", "page_no", F.get("bbox", F.lit(0)).alias("x0"), F.get("bbox", F.lit(1)).alias("y0"), "review_action")


@query(
    """SELECT e.extraction_id, p.page_no, r.x0, f.pos, f.field_page_type FROM fx_extractions e JOIN fx_pages p USING (page_id)
    LEFT JOIN fx_regions r ON e.region_id = r.region_id LEFT JOIN fx_field_defs f ON f.field_name = e.field_name""",
    "extractions", "pages", "regions", "field_defs",
)
def item_detail(spark, d):
    """PRJ9."""
    ext, pages, regions, defs = _many(spark, d, "extractions", "pages", "regions", "field_defs")
    rows = store.item_detail(ext, pages, regions.withColumn("bbox", F.array("x0")), defs)
    return rows.select("extraction_id", "page_no", F.get("bbox", F.lit(0)).alias("x0"), "pos", "field_page_type")


@query("SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 3 = 2 THEN concat('crop-', CAST(o_orderkey AS STRING)) ELSE concat('page-', CAST(o_orderkey AS STRING)) END AS image FROM orders")
def image_paths(spark, d):
    """PRJ16: crop or page image."""
    key = F.col("o_orderkey").cast("string")
    crop = F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 2, F.concat(F.lit("crop-"), key))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), store.image_of(crop, F.concat(F.lit("page-"), key)).alias("image"))


@query(
    """, k AS (SELECT min(extraction_id) AS x FROM fx_extractions WHERE field_name = 'f2'), t AS (SELECT e.*, p.doc_id FROM fx_extractions e JOIN fx_pages p USING (page_id), k WHERE extraction_id = k.x)
    SELECT 'schema' AS lookup, schema_id AS answer FROM fx_documents WHERE doc_id = 7 UNION ALL SELECT 'page image', 'page-5' FROM fx_pages WHERE page_id = 5
    UNION ALL SELECT 'extraction image', CASE WHEN region_id IS NULL THEN concat('page-', CAST(page_id AS STRING)) ELSE concat('crop-', region_id) END FROM t UNION ALL SELECT 'review target', concat(CAST(doc_id AS STRING), '.', field_name) FROM t""",
    "documents", "pages", "extractions",
)
def point_lookups(spark, d):
    """PRJ16: document to schema, page and extraction to image, review target."""
    docs, pages, ext = _many(spark, d, "documents", "pages", "extractions")
    pages = pages.withColumn("image_path", F.concat(F.lit("page-"), F.col("page_id").cast("string")))
    ext = ext.withColumn("crop_path", F.concat(F.lit("crop-"), "region_id"))
    key = ext.where("field_name = 'f2'").agg(F.min("extraction_id")).first()[0]
    target = store.review_target(ext, pages, key)
    answers = {
        "schema": store.schema_of(docs, 7).select("schema_id"), "page image": store.page_image(pages, 5).select("image_path"), "extraction image": store.extraction_image(ext, pages, key).select("image"),
        "review target": target.select(F.concat(F.col("doc_id").cast("string"), F.lit("."), "field_name").alias("x")),
    }
    return reduce(DataFrame.union, [df.select(F.lit(n).alias("lookup"), F.col(df.columns[0]).alias("answer")) for n, df in answers.items()])


@query(
    "SELECT page_id, field_name, field_name IN ('f1', 'f3') AND region_id IS NOT NULL AS routed, region_id IS NOT NULL AS all_types FROM (SELECT DISTINCT page_id, field_name, region_id FROM fx_extractions)",
    "extractions",
)
def crop_routing(spark, d):
    """PRJ13: fields read from their crop, by type or (no types named) all."""
    from .operators.extract import crop_routed

    kind = F.when(F.col("field_name") == "f1", "table").when(F.col("field_name") == "f3", "date").otherwise("string")
    has = F.col("region_id").isNotNull()
    return load(spark, d, "extractions").select("page_id", "field_name", "region_id").distinct().select("page_id", "field_name", crop_routed(kind, ["table", "date"], has).alias("routed"), crop_routed(kind, [], has).alias("all_types"))


# ---------------------------------------------------------------- documents

@query(
    f""", q AS ({_QUEUE}), w AS (SELECT doc_id, count(*) AS n_open FROM q GROUP BY 1),
    o AS (SELECT d.doc_id, count(e.extraction_id) AS n_fields, CAST(sum(CAST(e.flagged AS INT)) AS BIGINT) AS n_flagged FROM fx_documents d LEFT JOIN fx_pages p USING (doc_id) LEFT JOIN fx_extractions e USING (page_id) GROUP BY 1)
    SELECT o.*, coalesce(w.n_open, 0) AS n_open FROM o LEFT JOIN w USING (doc_id)""",
    "documents", "pages", "extractions", "reviews",
)
def docs_overview(spark, d):
    """J5 AGG2."""
    docs, pages, ext, reviews = _many(spark, d, "documents", "pages", "extractions", "reviews")
    return store.documents_overview(docs.select("doc_id"), pages, ext, store.review_queue(ext, pages, reviews))


@query(
    f""", q AS ({_QUEUE}) SELECT 'documents' AS table_name, count(*) AS n FROM fx_documents UNION ALL SELECT 'pages', count(*) FROM fx_pages
    UNION ALL SELECT 'extractions', count(*) FROM fx_extractions UNION ALL SELECT 'reviews', count(*) FROM fx_reviews UNION ALL SELECT 'regions', count(*) FROM fx_regions UNION ALL SELECT 'review_queue', count(*) FROM q""",
    "documents", "pages", "extractions", "reviews", "regions",
)
def table_counts(spark, d):
    """AGG1."""
    names = ["documents", "pages", "extractions", "reviews", "regions"]
    tables = dict(zip(names, _many(spark, d, *names)))
    return store.table_counts(tables | {"review_queue": store.review_queue(tables["extractions"], tables["pages"], tables["reviews"])})


@query("SELECT page_id, count(*) FILTER (flagged) AS n_flagged, count(*) AS n_fields FROM fx_extractions GROUP BY 1", "extractions")
def flagged_by_page(spark, d):
    """AGG3."""
    return store.flagged_by_page(load(spark, d, "extractions"))


@query("SELECT p.page_id, p.doc_id, p.page_no, d.schema_id FROM fx_pages p JOIN fx_documents d USING (doc_id) WHERE d.status <> 'failed'", "pages", "documents")
def pages_to_extract(spark, d):
    """PRJ3 J2."""
    return store.pages_to_extract(*_many(spark, d, "pages", "documents")).select("page_id", "doc_id", "page_no", "schema_id")


_SCOPE = """SELECT p.page_id, f.field_name FROM fx_pages p JOIN fx_field_defs f ON p.page_type IS NULL OR f.field_page_type IS NULL OR f.field_page_type = p.page_type"""


@query(f"SELECT page_id, count(*) AS n FROM ({_SCOPE}) t GROUP BY 1", "pages", "field_defs")
def fields_in_scope(spark, d):
    """PRJ12 J12."""
    return store.in_scope(*_many(spark, d, "pages", "field_defs")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query(f", s AS ({_SCOPE}) SELECT s.page_id, s.field_name FROM s WHERE NOT EXISTS (SELECT 1 FROM fx_extractions e WHERE e.page_id = s.page_id AND e.field_name = s.field_name)", "pages", "field_defs", "extractions")
def missing_fields(spark, d):
    """J10 FIN2."""
    pages, defs, ext = _many(spark, d, "pages", "field_defs", "extractions")
    return invariants.uncovered(pages, defs, ext)


@query(f", s AS ({_SCOPE}) SELECT s.page_id, s.field_name FROM s WHERE NOT EXISTS (SELECT 1 FROM fx_extractions e WHERE e.prompt_version = 'v1' AND e.page_id = s.page_id AND e.field_name = s.field_name)", "pages", "field_defs", "extractions")
def resume_fields(spark, d):
    """PRJ6 ORC7: fields that a run with this prompt version still needs."""
    pages, defs, ext = _many(spark, d, "pages", "field_defs", "extractions")
    return store.not_done(store.in_scope(pages, defs).select("page_id", "field_name"), ext, "v1")


@query("SELECT g.page_id, g.field_name, e.value AS stored_value FROM fx_gold g LEFT JOIN (SELECT * FROM fx_extractions WHERE prompt_version = 'v1') e USING (page_id, field_name)", "gold", "extractions")
def stored_values(spark, d):
    """PRJ7."""
    gold, ext = _many(spark, d, "gold", "extractions")
    return store.with_stored_values(gold.select("page_id", "field_name"), ext, "v1")


@query("SELECT sha256(text) AS file_hash, min(doc_id) AS path, count(*) AS copies FROM documents GROUP BY 1")
def dedupe_hash(spark, d):
    """SRC2 PRJ8."""
    return store.duplicate_files(read(spark, d, "documents").select(F.sha2("text", 256).alias("file_hash"), F.col("doc_id").alias("path")))


@query("SELECT sha256(text) AS file_hash, min(doc_id) AS path FROM documents GROUP BY 1 HAVING sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def new_files(spark, d):
    """PRJ8: files whose content is not known yet."""
    files = read(spark, d, "documents").select(F.sha2("text", 256).alias("file_hash"), F.col("doc_id").alias("path"))
    return store.new_files(files, files.where("path % 3 = 0"))


# ---------------------------------------------------------------- finalize

def _finalized(spark, d):
    """Fields of finalized documents; reviews here cover all flags of some."""
    ext, pages, reviews = _many(spark, d, "extractions", "pages", "reviews")
    ext = ext.where("NOT flagged OR page_id % 3 = 0")
    return finalize.final_fields(ext, pages, reviews, ["created_at", "extraction_id"])


_RESOLVED = f"""l AS ({_LAST_REVIEW}), e AS (SELECT * FROM fx_extractions WHERE NOT flagged OR page_id % 3 = 0),
    res AS (SELECT e.*, p.doc_id, p.page_no, l.review_id, CASE WHEN l.action = 'correct' THEN l.corrected_value WHEN l.action = 'reject' THEN NULL ELSE e.value END AS final_value
        FROM e JOIN fx_pages p USING (page_id) LEFT JOIN l ON l.extraction_id = e.extraction_id),
    refused AS (SELECT doc_id, count(*) AS n_open FROM res WHERE flagged AND review_id IS NULL GROUP BY 1),
    fin AS (SELECT doc_id, field_name, final_value, extraction_id, review_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field_name ORDER BY page_no DESC, created_at DESC, extraction_id DESC) AS rk FROM res) t
        WHERE rk = 1 AND doc_id NOT IN (SELECT doc_id FROM refused))"""
_FIN = ("extractions", "pages", "reviews")


@query(f", {_RESOLVED} SELECT * FROM fin", *_FIN)
def finalize_record(spark, d):
    """FIN1 TOP2 TOP3."""
    return _finalized(spark, d)[0]


@query(f", {_RESOLVED} SELECT * FROM refused", *_FIN)
def finalize_refused(spark, d):
    """FIN1: documents with open flags."""
    return _finalized(spark, d)[1]


def _records(spark, d):
    docs = load(spark, d, "documents")
    recs = finalize.records(_finalized(spark, d)[0], docs, F.lit("2025-01-01T00:00:00+00:00"))
    return store.records_to_export(recs, docs)


_RECORD_ID = "substr(sha256(concat(CAST(d.doc_id AS STRING), ':', d.schema_id, ':2025-01-01T00:00:00+00:00')), 1, 16)"


@query(
    f""", {_RESOLVED} SELECT {_RECORD_ID} AS record_id, d.doc_id, d.schema_id, d.source_path, """
    + ", ".join(f"coalesce(max(CASE WHEN field_name = 'f{i}' THEN final_value END), '') AS f{i}" for i in range(1, 8))
    + " FROM fin JOIN fx_documents d USING (doc_id) GROUP BY ALL",
    *_FIN, "documents",
)
def export_csv(spark, d):
    """PRJ5 J3 SNK2."""
    return finalize.csv_rows(_records(spark, d), [f"f{i}" for i in range(1, 8)])


@query(
    f""", {_RESOLVED} SELECT concat('{{"record_id":"', {_RECORD_ID}, '","doc_id":', CAST(d.doc_id AS STRING), ',"schema_id":"', d.schema_id, '","source_path":"', d.source_path,
    '","finalized_at":"2025-01-01T00:00:00+00:00", "fields": {{', string_agg(concat('"', field_name, '": ', coalesce(final_value, 'null')), ', ' ORDER BY field_name), '}}}}') AS value
    FROM fin JOIN fx_documents d USING (doc_id) GROUP BY d.doc_id, d.schema_id, d.source_path""",
    *_FIN, "documents",
)
def export_jsonl(spark, d):
    """SNK1 JS4."""
    return finalize.jsonl_rows(_records(spark, d)).select("value")


@query(
    f""", {_RESOLVED} SELECT {_RECORD_ID} AS study_id, CASE field_name WHEN 'f1' THEN 'age' WHEN 'f2' THEN 'dose' ELSE 'ward' END AS target, coalesce(final_value, '') AS cell
    FROM fin JOIN fx_documents d USING (doc_id) WHERE field_name IN ('f1', 'f2', 'f5')""",
    *_FIN, "documents",
)
def registry_rows(spark, d):
    """SNK4."""
    return finalize.registry_rows(_records(spark, d), {"f1": "age", "f2": "dose", "f5": "ward"}, "study_id")


@query(
    f""", {_RESOLVED} SELECT {_RECORD_ID} AS record_id, CASE WHEN d.doc_id % 2 = 0 THEN 'out.csv' END AS export_target FROM (SELECT DISTINCT doc_id FROM fin) f JOIN fx_documents d USING (doc_id)""",
    *_FIN, "documents",
)
def mark_exported(spark, d):
    """SNK3."""
    recs = _records(spark, d).select("record_id", "doc_id", F.lit(None).cast("string").alias("exported_at"), F.lit(None).cast("string").alias("export_target"))
    return store.mark_exported(recs, recs.where("doc_id % 2 = 0"), "out.csv", F.lit("2025-01-02")).select("record_id", "export_target")


@query(
    f""", {_RESOLVED} SELECT f.doc_id, f.extraction_id FROM fin f JOIN fx_extractions e USING (extraction_id) WHERE e.flagged AND f.review_id IS NULL
    UNION ALL SELECT p.doc_id, e.extraction_id FROM fx_extractions e JOIN fx_pages p USING (page_id) WHERE e.flagged AND NOT EXISTS (SELECT 1 FROM fx_reviews r WHERE r.extraction_id = e.extraction_id) AND p.doc_id IN (SELECT doc_id FROM fin)""",
    *_FIN,
)
def unreviewed_in_records(spark, d):
    """FIN4 J9: flags without review in documents with a record, other runs' too."""
    ext, pages, reviews = _many(spark, d, *_FIN)
    return invariants.unreviewed_in_records(_finalized(spark, d)[0], pages, ext, reviews)


@query(
    f""", {_RESOLVED} SELECT {_RECORD_ID} AS record_id, f.field_name, 'unknown extraction' AS problem FROM fin f JOIN fx_documents d USING (doc_id) JOIN fx_extractions e USING (extraction_id) WHERE e.page_id % 5 = 0""",
    *_FIN, "documents",
)
def provenance_open(spark, d):
    """FIN5: sources that a store without some extractions no longer has."""
    return invariants.open_provenance(_records(spark, d), load(spark, d, "extractions").where("page_id % 5 <> 0"))


@query(f", {_RESOLVED} SELECT CAST(doc_id AS STRING) AS record_id, 'f1' AS \"column\" FROM fin WHERE field_name = 'f1' AND doc_id % 10 = 0", *_FIN)
def csv_cells_differ(spark, d):
    """FIN6: cells of an export that was changed in places."""
    want = finalize.csv_rows(_records(spark, d), ["f1", "f2"]).select(F.col("doc_id").cast("string").alias("record_id"), "f1", "f2")
    has = _finalized(spark, d)[0].where("field_name = 'f1' AND doc_id % 10 = 0").select(F.col("doc_id").cast("string").alias("record_id"), F.lit(True).alias("spoil"))
    got = want.join(has, "record_id", "left").withColumn("f1", F.when(F.col("spoil"), F.concat(F.lit("x"), "f1")).otherwise(F.col("f1"))).drop("spoil")
    return invariants.cells_differ(got, want)


# ---------------------------------------------------------------- changes

@query(
    """, c AS (SELECT doc_id FROM fx_documents WHERE doc_id % 10 = 3), p AS (SELECT page_id FROM fx_pages WHERE doc_id IN (SELECT doc_id FROM c)), e AS (SELECT extraction_id FROM fx_extractions WHERE page_id IN (SELECT page_id FROM p))
    SELECT 'documents' AS table_name, count(*) AS n FROM fx_documents WHERE doc_id NOT IN (SELECT doc_id FROM c)
    UNION ALL SELECT 'pages', count(*) FROM fx_pages WHERE page_id NOT IN (SELECT page_id FROM p) UNION ALL SELECT 'extractions', count(*) FROM fx_extractions WHERE page_id NOT IN (SELECT page_id FROM p)
    UNION ALL SELECT 'regions', count(*) FROM fx_regions WHERE page_id NOT IN (SELECT page_id FROM p) UNION ALL SELECT 'reviews', count(*) FROM fx_reviews WHERE extraction_id NOT IN (SELECT extraction_id FROM e)
    UNION ALL SELECT 'records', count(*) FROM fx_documents WHERE doc_id NOT IN (SELECT doc_id FROM c)""",
    "documents", "pages", "extractions", "reviews", "regions",
)
def purge(spark, d):
    """DML9."""
    names = ["documents", "pages", "extractions", "reviews", "regions"]
    tables = dict(zip(names, _many(spark, d, *names)))
    tables["records"] = tables["documents"]
    return store.table_counts(store.purge(tables, tables["documents"].where("doc_id % 10 = 3")))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'read' WHEN page_id % 4 = 1 THEN coalesce(page_type, 'other') ELSE coalesce(page_type, 'other') END AS page_type FROM fx_pages", "pages")
def page_types(spark, d):
    """DML6."""
    pages = load(spark, d, "pages")
    read_now = pages.where("page_id % 4 < 2").select("page_id", F.when(F.col("page_id") % 4 == 0, "read").alias("page_type"))
    return store.page_types(pages, read_now, "other").select("page_id", "page_type")


@query("SELECT doc_id, CASE WHEN status = 'ingested' AND doc_id IN (SELECT doc_id FROM fx_pages) THEN 'extracted' ELSE status END AS status FROM fx_documents", "documents", "pages")
def mark_extracted(spark, d):
    """DML8."""
    return store.mark_extracted(*_many(spark, d, "documents", "pages")).select("doc_id", "status")


@query("SELECT r_name AS key, CASE WHEN r_regionkey < 2 THEN 'new' ELSE 'old' END AS value FROM region UNION ALL SELECT 'added', 'new'")
def upsert_meta(spark, d):
    """DML10."""
    region = read(spark, d, "region")
    changes = region.where("r_regionkey < 2").select(F.col("r_name").alias("key"), F.lit("new").alias("value")).union(spark.range(1).select(F.lit("added"), F.lit("new")))
    return store.upsert_meta(region.select(F.col("r_name").alias("key"), F.lit("old").alias("value")), changes)


# ---------------------------------------------------------------- coercion


def _coerced(spark, d, fd: FieldDef, projection: str = "raw_values"):
    rows = load(spark, d, projection).withColumn("v", F.try_parse_json("raw")).withColumn("c", held(co.coerce(F.col("v"), fd)))
    return rows.select("event_id", F.col("c.value").alias("value"), F.col("c.error").alias("error"))


_AGE = FieldDef("age", "integer", min=0.0, max=120.0)


@query(
    """, r AS (SELECT event_id, event_id % 12 AS k, event_id % 150 AS n, raw, trim(raw, '"') AS s FROM fx_raw_values),
    e AS (SELECT *, CASE WHEN k IN (0, 1, 2) AND n > 120 THEN CAST(n AS STRING) || ' is above max 120.0' WHEN k IN (0, 1, 2, 6) THEN NULL WHEN k = 3 THEN s || ' has a fractional part'
        WHEN k = 5 THEN 'boolean is not an integer' WHEN k = 10 THEN 'cannot coerce list to integer' ELSE chr(39) || s || chr(39) || ' is not an integer' END AS m FROM r)
    SELECT event_id, CASE WHEN k IN (0, 1, 2) AND m IS NULL THEN n END AS value, 'age: coercion failed -- ' || m AS error FROM e""",
    "raw_values",
)
def coerce_integer(spark, d):
    """CO1 CO9 CO10."""
    return _coerced(spark, d, _AGE).withColumn("value", F.col("value").cast("bigint"))


@query(
    """SELECT event_id, CASE WHEN event_id % 4 < 3 THEN sign || digits END AS value, CASE WHEN event_id % 4 = 3 THEN 'n: coercion failed -- ' || sign || digits || digits || digits || ' has more than 38 digits' END AS error
    FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '' ELSE '-' END AS sign, CAST(1000000000000000000 + event_id AS STRING) || CASE WHEN event_id % 4 = 2 THEN '00' ELSE '' END AS digits FROM events)"""
)
def coerce_long_integer(spark, d):
    """CO1: integers that 64 bits hold, do not hold, and of over 38 digits."""
    key = F.col("event_id")
    sign, digits = F.when(key % 2 == 0, "").otherwise("-"), F.concat((key + F.lit(1000000000000000000)).cast("string"), F.when(key % 4 == 2, "00").otherwise(""))
    raw = F.when(key % 4 == 3, F.concat(F.lit('"'), sign, digits, digits, digits, F.lit('"'))).otherwise(F.concat(sign, digits))
    rows = read(spark, d, "events").withColumn("c", held(co.coerce(F.try_parse_json(raw), FieldDef("n", "integer"))))
    return rows.select("event_id", F.col("c.value").cast("string").alias("value"), F.col("c.error").alias("error"))


@query(
    """, r AS (SELECT event_id, event_id % 12 AS k, event_id % 150 AS n, raw, trim(raw, '"') AS s FROM fx_raw_values),
    v AS (SELECT *, CASE WHEN k IN (0, 1, 2) THEN CAST(n AS DOUBLE) WHEN k = 3 THEN n + 0.5 WHEN k = 4 THEN n + 0.25 END AS x FROM r),
    e AS (SELECT *, CASE WHEN k = 6 THEN NULL WHEN k = 5 THEN 'boolean is not a number' WHEN k = 10 THEN 'cannot coerce list to float' WHEN x IS NULL THEN chr(39) || s || chr(39) || ' is not a number'
        WHEN x < 25 THEN CAST(x AS STRING) || ' is below min 25.0' WHEN x > 45 THEN CAST(x AS STRING) || ' is above max 45.0' END AS m FROM v)
    SELECT event_id, CASE WHEN m IS NULL THEN x END AS value, 'temp: coercion failed -- ' || m AS error FROM e""",
    "raw_values",
)
def coerce_float(spark, d):
    """CO2 CO9."""
    return _coerced(spark, d, FieldDef("temp", "float", min=25.0, max=45.0))


@query(
    """, r AS (SELECT event_id, event_id % 12 AS k, trim(raw, '"') AS s FROM fx_raw_values),
    e AS (SELECT *, CASE WHEN k = 6 THEN NULL WHEN k IN (0) THEN 'date must be a string, got int' WHEN k IN (2, 3) THEN 'date must be a string, got float' WHEN k = 5 THEN 'date must be a string, got bool' WHEN k = 10 THEN 'date must be a string, got list'
        WHEN try_strptime(trim(s), '%d/%m/%Y') IS NULL THEN chr(39) || s || chr(39) || ' does not parse as %d/%m/%Y' END AS m FROM r)
    SELECT event_id, CASE WHEN m IS NULL AND k <> 6 THEN trim(s) END AS value, 'seen: coercion failed -- ' || m AS error FROM e""",
    "raw_values",
)
def coerce_date(spark, d):
    """CO3."""
    return _coerced(spark, d, FieldDef("seen", "date"))


@query(
    """, r AS (SELECT event_id, event_id % 12 AS k, trim(raw, '"') AS s FROM fx_raw_values),
    v AS (SELECT *, CASE lower(trim(s)) WHEN 'view' THEN 'View' WHEN 'click' THEN 'Click' WHEN 'error' THEN 'error' END AS x FROM r),
    e AS (SELECT *, CASE WHEN k = 6 THEN NULL WHEN k = 0 THEN 'enum value must be a string, got int' WHEN k IN (2, 3) THEN 'enum value must be a string, got float' WHEN k = 5 THEN 'enum value must be a string, got bool' WHEN k = 10 THEN 'enum value must be a string, got list'
        WHEN x IS NULL THEN chr(39) || s || chr(39) || ' is not one of [''View'', ''Click'', ''error'']' END AS m FROM v)
    SELECT event_id, CASE WHEN m IS NULL AND k <> 6 THEN x END AS value, 'kind: coercion failed -- ' || m AS error FROM e""",
    "raw_values",
)
def coerce_enum(spark, d):
    """CO4."""
    return _coerced(spark, d, FieldDef("kind", "enum", values=("View", "Click", "error")))


@query(
    """, r AS (SELECT event_id, event_id % 12 AS k, trim(raw, '"') AS s, regexp_extract(raw, '"([a-z]+)"', 1) AS w FROM fx_raw_values)
    SELECT event_id, CASE WHEN k = 5 THEN true END AS value, CASE WHEN k IN (0, 2, 3) THEN 'ok: coercion failed -- ' || s || ' is not a boolean' WHEN k = 10 THEN 'ok: coercion failed -- [' || chr(39) || w || chr(39) || ', ' || chr(39) || 'View' || chr(39) || '] is not a boolean'
        WHEN k NOT IN (5, 6) THEN 'ok: coercion failed -- ' || chr(39) || s || chr(39) || ' is not a boolean' END AS error FROM r""",
    "raw_values",
)
def coerce_boolean(spark, d):
    """CO5."""
    return _coerced(spark, d, FieldDef("ok", "boolean"))


@query(
    """, r AS (SELECT event_id, event_id % 12 AS k, regexp_extract(raw, '"([a-z]+)"', 1) AS s FROM fx_raw_values)
    SELECT event_id, CASE WHEN k = 10 AND s IN ('view', 'click') THEN (CASE s WHEN 'view' THEN 'view' ELSE 'CLICK' END) || '|view' END AS value,
    CASE WHEN k = 6 THEN NULL WHEN k <> 10 THEN 'set: coercion failed -- checkbox_group must be a list' WHEN s NOT IN ('view', 'click') THEN 'set: coercion failed -- ' || chr(39) || s || chr(39) || ' is not one of [''view'', ''CLICK'']' END AS error FROM r""",
    "raw_values",
)
def coerce_checkbox_group(spark, d):
    """CO6."""
    return _coerced(spark, d, FieldDef("set", "checkbox_group", values=("view", "CLICK"))).withColumn("value", F.array_join("value", "|"))


@query(
    """, r AS (SELECT event_id, event_id % 12 AS k, trim(raw, '"') AS s FROM fx_raw_values),
    e AS (SELECT *, CASE WHEN k = 6 THEN NULL WHEN k = 0 THEN 'expected a string, got int' WHEN k IN (2, 3) THEN 'expected a string, got float' WHEN k = 5 THEN 'expected a string, got bool' WHEN k = 10 THEN 'expected a string, got list'
        WHEN length(trim(s)) > 6 THEN 'length ' || CAST(length(trim(s)) AS STRING) || ' exceeds max_length 6' WHEN NOT regexp_full_match(trim(s), '[a-z0-9. ]+') THEN chr(39) || trim(s) || chr(39) || ' does not match [a-z0-9. ]+' END AS m FROM r)
    SELECT event_id, CASE WHEN m IS NULL AND k <> 6 THEN trim(s) END AS value, 'note: coercion failed -- ' || m AS error FROM e""",
    "raw_values",
)
def coerce_string(spark, d):
    """CO7."""
    return _coerced(spark, d, FieldDef("note", "string", max_length=6, regex="[a-z0-9. ]+"))


@query(
    """, r AS (SELECT event_id, event_id % 5 AS k, event_id % 20 AS n, regexp_extract(raw, '"drug": "([a-z]+)"', 1) AS s FROM fx_table_values),
    e AS (SELECT *, CASE WHEN k = 4 THEN 'table must be a list of row objects' WHEN k = 2 THEN 'row 0 has unknown columns [''unit'']' WHEN k = 3 THEN 'row 0: dose: coercion failed -- ' || chr(39) || CAST(n AS STRING) || ' mg' || chr(39) || ' is not an integer'
        WHEN k = 0 AND n > 15 THEN 'row 0: dose: coercion failed -- ' || CAST(n AS STRING) || ' is above max 15.0' WHEN k = 1 AND n > 15 THEN 'row 1: dose: coercion failed -- ' || CAST(n AS STRING) || ' is above max 15.0' END AS m FROM r)
    SELECT event_id, CASE WHEN m IS NOT NULL THEN 'null' WHEN k = 0 THEN '[{"drug":"' || s || '","dose":' || CAST(n AS STRING) || '}]' ELSE '[{"drug":"' || s || '","dose":null},{"drug":null,"dose":' || CAST(n AS STRING) || '}]' END AS value,
    'meds: coercion failed -- ' || m AS error FROM e""",
    "table_values",
)
def coerce_table(spark, d):
    """CO8 JS4."""
    fd = FieldDef("meds", "table", columns=(FieldDef("drug", "string"), FieldDef("dose", "integer", max=15.0)))
    return _coerced(spark, d, fd, "table_values").withColumn("value", co.json_text(F.col("value")))


# ---------------------------------------------------------------- confidence

_COMPOSITE = """s AS (SELECT extraction_id, flagged, legible, value, raw_transcription, page_id % 10 = 0 AS failed, model_confidence AS c,
    CASE WHEN value IS NULL OR page_id % 10 = 0 THEN 1.0 WHEN raw_transcription IS NULL THEN 0.5 WHEN regexp_extract(raw_transcription, '[0-9]+') = value THEN 1.0 ELSE 0.0 END AS agree FROM fx_extractions),
    t AS (SELECT *, least(greatest(c, 0), 1) * (0.6 + 0.4 * agree) * CASE WHEN failed THEN 0.2 ELSE 1.0 END AS composite FROM s)"""


def _outcomes(spark, d):
    fd = FieldDef("dose", "integer", required=True)
    rows = load(spark, d, "extractions")
    failed = F.col("page_id") % 10 == 0
    value = F.when(~failed, F.col("value").cast("bigint"))
    out = score.outcome(value, F.when(failed, F.lit("x")), F.col("legible"), F.col("model_confidence"), F.col("raw_transcription"), fd, 0.85)
    return rows.withColumn("o", held(out)).select("extraction_id", "page_id", "flagged", *[F.col(f"o.{c}").alias(c if c != "flagged" else "must_flag") for c in ("status", "composite", "flagged", "flag_reason")])


@query(
    f""", {_COMPOSITE}, f AS (SELECT *, failed OR value IS NULL AS empty FROM t)
    SELECT extraction_id, CASE WHEN failed THEN 'fail' ELSE 'pass' END AS status, round(composite, 6) AS composite,
    failed OR NOT legible OR empty OR (NOT empty AND composite < 0.85) AS must_flag,
    CASE WHEN failed OR NOT legible OR empty OR (NOT empty AND composite < 0.85) THEN concat_ws('; ', CASE WHEN failed THEN 'coercion/validation failed' END, CASE WHEN NOT legible THEN 'model reports illegible' END,
        CASE WHEN empty THEN 'required field is null' END, CASE WHEN NOT empty AND composite < 0.85 THEN printf('composite confidence %.2f below threshold 0.85', composite) END) END AS flag_reason FROM f""",
    "extractions",
)
def composite_flags(spark, d):
    """VAL1 VAL2 VAL3."""
    return _outcomes(spark, d).select("extraction_id", "status", F.round("composite", 6).alias("composite"), "must_flag", "flag_reason")


@query(
    f""", {_COMPOSITE} SELECT extraction_id FROM t WHERE NOT flagged AND (failed OR NOT legible OR value IS NULL OR (value IS NOT NULL AND NOT failed AND composite < 0.85))""",
    "extractions",
)
def wrongly_unflagged(spark, d):
    """FIN3."""
    return invariants.wrongly_unflagged(_outcomes(spark, d), F.col("must_flag"))


@query(
    """ SELECT event_id, CASE WHEN kind = 6 THEN NULL ELSE CAST(regexp_extract(text, '"k": ([0-9]+)', 1) AS BIGINT) END AS k, kind IN (6) AS unparsed FROM fx_completions""",
    "completions",
)
def json_repair(spark, d):
    """JS1 JS2 JS3 JS5 VAL5."""
    rows = parsed(load(spark, d, "completions"), "text", "v")
    return rows.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), (~is_object(F.col("v"))).alias("unparsed"))


@query(
    """ SELECT event_id, CAST(event_id % 50 AS BIGINT) AS value, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false ELSE true END AS legible, CASE event_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.0 ELSE 1.0 END AS confidence,
    CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 50 AS STRING) END AS raw FROM events"""
)
def envelope_defaults(spark, d):
    """VAL4."""
    n, key = F.col("event_id") % 50, F.col("event_id")
    legible = F.when(key % 4 == 0, ', "legible": true').when(key % 4 == 1, "").when(key % 4 == 2, ', "legible": null').otherwise(', "legible": 1')
    conf = F.when(key % 3 == 0, ', "confidence": 0.5').when(key % 3 == 1, ', "confidence": "high"').otherwise(', "confidence": true')
    raw = F.when(key % 2 == 0, F.concat(F.lit(', "raw_transcription": '), n.cast("string"))).otherwise("")
    rows = read(spark, d, "events").withColumn("text", F.concat(F.lit('{"value": '), n.cast("string"), legible, conf, raw, F.lit("}")))
    rows = parsed(rows, "text", "v").withColumn("e", envelope(F.col("v")))
    return rows.select("event_id", F.try_variant_get("e.value", "$", "bigint").alias("value"), "e.legible", "e.confidence", F.col("e.raw_transcription").alias("raw"))


@query(
    """, e AS (SELECT *, min(created_at || extraction_id) OVER (PARTITION BY page_id, field_name) AS m FROM fx_extractions), a AS (SELECT * FROM e WHERE created_at || extraction_id = m AND prompt_version = 'v0'),
    b AS (SELECT page_id, field_name, value, row_number() OVER (PARTITION BY page_id, field_name ORDER BY created_at DESC, extraction_id DESC) AS rn FROM fx_extractions WHERE prompt_version = 'v1')
    SELECT a.extraction_id, a.flagged OR (a.value IS NOT NULL AND NOT a.flagged AND b.page_id IS NOT NULL AND a.value IS DISTINCT FROM b.value) AS flagged,
    round(a.model_confidence * CASE WHEN a.value IS NOT NULL AND NOT a.flagged AND b.page_id IS NOT NULL AND a.value IS DISTINCT FROM b.value THEN 0.5 ELSE 1.0 END, 6) AS composite,
    CASE WHEN a.value IS NOT NULL AND NOT a.flagged AND b.page_id IS NOT NULL AND a.value IS DISTINCT FROM b.value THEN 'verify pass disagreement: second read from the crop gave ' || coalesce(b.value, 'null') END AS flag_reason
    FROM a LEFT JOIN (SELECT * FROM b WHERE rn = 1) b ON a.page_id = b.page_id AND a.field_name = b.field_name""",
    "extractions",
)
def verify_pass(spark, d):
    """VAL6: a second reading that disagrees flags an accepted one."""
    from .operators.extract import verified

    ext = load(spark, d, "extractions")
    first = ext.groupBy("page_id", "field_name").agg(F.min_by(F.struct(*[c for c in ext.columns if c not in ("page_id", "field_name")]), F.struct("created_at", "extraction_id")).alias("r")).select("page_id", "field_name", "r.*")
    first = first.where("prompt_version = 'v0'").select("extraction_id", "page_id", "field_name", "value", "flagged", F.col("model_confidence").alias("composite"), F.lit(None).cast("string").alias("flag_reason"), F.lit(None).cast("string").alias("note"))
    second = newest(ext.where("prompt_version = 'v1'"), ["page_id", "field_name"], ["created_at", "extraction_id"], ["value", "raw_transcription"])
    out = verified(first, second, numbers_match(F.col("value"), F.col("verify_value")), primary_is_crop=F.lit(False))
    return out.select("extraction_id", "flagged", F.round("composite", 6).alias("composite"), "flag_reason")


@query(
    """SELECT a.event_id AS page_id, CAST(round_even(a.event_id % 40 + 0.5 + CASE WHEN a.event_id % 3 = 0 THEN coalesce(b.ms, 0) ELSE 0 END, 0) AS INT) AS latency_ms
    FROM events a LEFT JOIN (SELECT event_id, user_id % 25 + 0.5 AS ms FROM events WHERE event_id % 2 = 0) b USING (event_id)"""
)
def latency_totals(spark, d):
    """AGG12: time of the first reply, and of the retry where there was one."""
    from .operators.extract import read_fields

    ev, key = read(spark, d, "events"), F.col("event_id")
    first = ev.select(key.alias("page_id"), F.lit("primary").alias("role"), F.when(key % 3 == 0, "no object").otherwise('{"value": 1}').alias("text"), (key % 40 + F.lit(0.5)).alias("latency_ms"))
    again = ev.where(key % 2 == 0).select(key.alias("page_id"), F.lit("retry").alias("role"), F.lit('{"value": 2}').alias("text"), (F.col("user_id") % 25 + F.lit(0.5)).alias("latency_ms"))
    replies = first.unionByName(again).withColumn("field_name", F.lit("f")).withColumn("latency_ms", F.col("latency_ms").cast("double"))
    return read_fields(replies, [FieldDef("f", "integer")], 0.85).select("page_id", "latency_ms")


@query(
    """, r AS (SELECT event_id, event_id % 12 AS k, event_id % 150 AS n, raw, trim(raw, '"') AS s FROM fx_raw_values)
    SELECT event_id, action, CASE WHEN problem IS NULL AND action = 'correct' THEN CAST(n AS STRING) END AS corrected_value, problem FROM (
        SELECT *, CASE WHEN action = 'burn' THEN 'no such action: ' || chr(39) || 'burn' || chr(39) WHEN action <> 'correct' THEN NULL WHEN k = 6 THEN 'age is required: reject it to leave it empty'
            WHEN k IN (0, 1, 2) AND n > 120 THEN 'age: coercion failed -- ' || CAST(n AS STRING) || ' is above max 120.0' WHEN k IN (0, 1, 2) THEN NULL WHEN k = 3 THEN 'age: coercion failed -- ' || s || ' has a fractional part'
            WHEN k = 5 THEN 'age: coercion failed -- boolean is not an integer' WHEN k = 10 THEN 'age: coercion failed -- cannot coerce list to integer' ELSE 'age: coercion failed -- ' || chr(39) || s || chr(39) || ' is not an integer' END AS problem
        FROM (SELECT *, CASE event_id % 7 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' WHEN 2 THEN 'burn' ELSE 'correct' END AS action FROM r) x) y""",
    "raw_values",
)
def review_checks(spark, d):
    """VAL7 DML4: corrections are coerced as their field asks before they are kept."""
    from .operators import review

    rows, key = load(spark, d, "raw_values"), F.col("event_id")
    action = F.when(key % 7 == 0, "accept").when(key % 7 == 1, "reject").when(key % 7 == 2, "burn").otherwise("correct")
    given = rows.select("event_id", key.alias("extraction_id"), action.alias("action"), F.col("raw").alias("corrected_value"))
    known = rows.select(key.alias("extraction_id"), F.lit("age").alias("field_name"))
    schema = Schema("fx", fields=(FieldDef("age", "integer", required=True, min=0.0, max=120.0),))
    return review.checked(given, known, schema).select("event_id", "action", "corrected_value", "problem")


# ---------------------------------------------------------------- rules

_RULES = Schema(
    "fx", fields=(FieldDef("qty", "integer"), FieldDef("price", "float"), FieldDef("flag", "string"), FieldDef("size", "integer", page_type="O")), page_types=("F", "O"),
    rules=(Rule("qty <= 40"), Rule("price / qty > 100 if qty else True"), Rule("flag in ['A', 'N'] or qty > 5"), Rule("size > 10"), Rule("len(flag) == 1 and 0 < qty < 49"), Rule("qty is None or price is not None", message="price is needed")),
)


@query(
    """ SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_shipdate AS DATE) AS STRING) AS day, concat_ws('|', CASE WHEN q > 40 THEN 'qty <= 40' END, CASE WHEN q IS NOT NULL AND p / q <= 100 THEN 'price / qty > 100 if qty else True' END,
    CASE WHEN q IS NOT NULL AND NOT (l_returnflag IN ('A', 'N') OR q > 5) THEN 'flag in [''A'', ''N''] or qty > 5' END, CASE WHEN q IS NOT NULL AND NOT (0 < q AND q < 49) THEN 'len(flag) == 1 and 0 < qty < 49' END) AS failed
    FROM (SELECT *, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(l_quantity AS INT) END AS q, l_extendedprice AS p FROM lineitem)"""
)
def rules(spark, d):
    """RUL1 RUL2 RUL3: indeterminate rules do not fail."""
    rows = read(spark, d, "lineitem").withColumn("qty", F.when(F.col("l_partkey") % 11 != 0, F.col("l_quantity").cast("int")))
    cols = {"qty": F.col("qty"), "price": F.col("l_extendedprice"), "flag": F.col("l_returnflag"), "size": F.lit(1)}
    out = failed_rules(rows, _RULES, "F", cols)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").cast("string").alias("day"), F.array_join(F.transform("failed_rules", lambda r: r["rule"]), "|").alias("failed"))


@query(
    """, n AS (SELECT page_id, max(CASE WHEN field_name = 'f1' THEN CAST(value AS INT) END) AS f1, max(CASE WHEN field_name = 'f2' THEN CAST(value AS INT) END) AS f2 FROM fx_extractions WHERE prompt_version = 'v1' GROUP BY 1)
    SELECT e.extraction_id, e.flagged OR coalesce(n.f1 + n.f2 >= 60, false) AS flagged, CASE WHEN n.f1 + n.f2 >= 60 THEN 'cross-field rule failed: too much' END AS flag_reason
    FROM fx_extractions e LEFT JOIN n USING (page_id) WHERE e.prompt_version = 'v1' AND e.field_name IN ('f1', 'f2')""",
    "extractions",
)
def rule_flags(spark, d):
    """RUL4 DML7."""
    from .plans.rules import flag_from_rules

    ext = load(spark, d, "extractions").where("prompt_version = 'v1'").withColumn("flag_reason", F.lit(None).cast("string"))
    cols = [F.max(F.when(F.col("field_name") == f, F.col("value").cast("int"))).alias(f) for f in ("f1", "f2")]
    schema = Schema("fx", fields=(FieldDef("f1", "integer"), FieldDef("f2", "integer")), rules=(Rule("f1 + f2 < 60", message="too much"),))
    failures = failed_rules(ext.groupBy("page_id").agg(*cols), schema, None)
    return flag_from_rules(ext, failures, ["page_id"]).where("field_name IN ('f1', 'f2')").select("extraction_id", "flagged", "flag_reason")


# ---------------------------------------------------------------- texts

@query(
    r"""WITH t AS (SELECT doc_id, replace(replace(text, 'a', 'A'), ' ', '  ') AS a FROM documents)
    SELECT doc_id, trim(regexp_replace(lower(regexp_replace(nfc_normalize(a), '[.,;:\-'']', ' ', 'g')), '\s+', ' ', 'g')) AS form FROM t"""
)
def norm_match(spark, d):
    """CMP2: comparison form of whole texts.  SQL has no compatibility form: the
    tables' texts are in it, and other texts are tested one by one."""
    rows = read(spark, d, "documents").withColumn("a", F.replace(F.replace("text", F.lit("a"), F.lit("A")), F.lit(" "), F.lit("  ")))
    return rows.select("doc_id", comparison_form(F.col("a")).alias("form"))


#: Readings with faults: words that begin with one of these letters are misread.
_MISREAD = r"(^|[^a-zA-Z0-9])([a-gA-G])"
_BENCH = rf"""b AS (SELECT item_id, item_id % 7 AS page, text, regexp_replace(text, '{_MISREAD}', '\1zz\2', 'g') AS misread FROM benchmark), g AS (SELECT item_id, page, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tk FROM b),
    c AS (SELECT item_id, page, list_distinct(regexp_extract_all(lower(misread), '[a-z0-9]+')) AS tk FROM b),
    near AS (SELECT g.item_id AS gi, c.item_id AS ci FROM g JOIN c USING (page) WHERE len(g.tk) > 0 AND len(list_intersect(g.tk, c.tk)) / len(g.tk) >= 0.6)"""


def _benchmark(spark, d):
    rows = read(spark, d, "benchmark").select("item_id", (F.col("item_id") % 7).alias("page"), "text")
    return rows, rows.withColumn("text", F.regexp_replace("text", _MISREAD, "$1zz$2"))


@query(f"WITH {_BENCH} SELECT item_id, item_id IN (SELECT gi FROM near) AS hit, item_id NOT IN (SELECT ci FROM near) AS spurious FROM b")
def token_match(spark, d):
    """CMP3 CMP4 J11."""
    gold, got = _benchmark(spark, d)
    a, b = evaluate.token_matches(gold, got, "page", "text", "text", "item_id")
    return a.select("item_id", "hit").join(b.select("item_id", "spurious"), "item_id")


@query(
    f"WITH {_BENCH}, s AS (SELECT (SELECT count(DISTINCT gi) FROM near) AS tp, (SELECT count(*) FROM b) - (SELECT count(DISTINCT gi) FROM near) AS fn, (SELECT count(*) FROM b) - (SELECT count(DISTINCT ci) FROM near) AS fp) "
    "SELECT tp, fn, fp, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM s"
)
def token_scores(spark, d):
    """AGG8."""
    gold, got = _benchmark(spark, d)
    out = evaluate.token_scores(*evaluate.token_matches(gold, got, "page", "text", "text", "item_id"))
    return out.select("tp", "fn", "fp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    f"""WITH {_BENCH}, r AS (SELECT page, unnest(regexp_extract_all(lower(misread), '[a-z0-9]+')) AS w FROM b)
    SELECT count(*) AS n, count(*) FILTER ((page, lower(regexp_extract(text, '[A-Za-z]+'))) IN (SELECT (page, w) FROM r)) AS read FROM b WHERE regexp_extract(text, '[A-Za-z]+') <> ''"""
)
def brand_recall(spark, d):
    """AGG9."""
    gold, got = _benchmark(spark, d)
    return evaluate.brand_recall(gold, got, "page", "text", "text")


@query(
    f", {_JUDGED} SELECT count(*) AS pages, round(avg(CAST(e AS INT)), 6) AS exact_rate, round(avg(CAST(f AS INT)), 6) AS flag_rate FROM (SELECT page_id, bool_and(ok) AS e, bool_or(flagged) AS f FROM j WHERE found GROUP BY 1) t",
    "gold", "extractions",
)
def page_rates(spark, d):
    """AGG10: pages whose every gold field was read exactly, and with a flag."""
    rows = _judged(spark, d).where("found").groupBy("page_id").agg(F.bool_and("ok").alias("exact"), F.bool_or("flagged").alias("flagged"))
    return evaluate.page_rates(rows).select("pages", F.round("exact_rate", 6).alias("exact_rate"), F.round("flag_rate", 6).alias("flag_rate"))


@query(
    """SELECT doc_id, extraction_id, value, flagged FROM (SELECT e.*, p.doc_id, row_number() OVER (PARTITION BY p.doc_id ORDER BY e.created_at DESC, e.extraction_id DESC) AS rn FROM fx_extractions e JOIN fx_pages p USING (page_id) WHERE e.field_name = 'f3') t WHERE rn = 1""",
    "extractions", "pages",
)
def newest_of_field(spark, d):
    """TOP5: the newest reading of one field for each document."""
    ext, pages = _many(spark, d, "extractions", "pages")
    return evaluate.newest_of_field(ext, pages, "f3", ["created_at", "extraction_id"]).select("doc_id", "extraction_id", "value", "flagged")


@query(r"SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS n_tokens, lower(regexp_extract(text, '[A-Za-z]+')) AS brand FROM documents")
def token_sets(spark, d):
    """CMP3: whole texts of all documents."""
    rows = read(spark, d, "documents")
    return rows.select("doc_id", F.size(token_set(F.col("text"))).cast("long").alias("n_tokens"), F.coalesce(F.lower(first_word(F.col("text"))), F.lit("")).alias("brand"))


@query(
    """WITH e AS (SELECT event_id, event_id % 10 = 0 AS nulls, event_id % 5 = 0 AS one, user_id % 3 AS a, user_id % 4 AS b, event_id % 7 = 0 AS short, event_id % 2 = 0 AS p, event_id % 3 = 0 AS q FROM events)
    SELECT event_id, CASE WHEN one THEN nulls ELSE a = b END AS texts, CASE WHEN one THEN nulls ELSE NOT short AND a = b END AS lists, CASE WHEN one THEN nulls ELSE NOT short AND a = b END AS tables, CASE WHEN one THEN nulls ELSE p = q END AS booleans,
        CASE WHEN one THEN nulls ELSE abs(a - b) < 1e-9 END AS numbers FROM e"""
)
def value_match(spark, d):
    """CMP1: equality of texts, lists, table rows, booleans and numbers."""
    key, a, b = F.col("event_id"), F.col("user_id") % 3, F.col("user_id") % 4
    table = FieldDef("f", "table", columns=(FieldDef("drug", "string"), FieldDef("dose", "float")))
    rows = lambda n, x: F.array(F.struct(n.alias("drug"), x.cast("double").alias("dose")))
    cut = lambda x: F.when(key % 7 == 0, F.slice(x, 1, 0)).otherwise(x)
    kinds = {
        "texts": (FieldDef("f", "string"), F.concat("event_type", F.lit(". "), a.cast("string")), F.concat(F.upper("event_type"), F.lit("-"), b.cast("string"))),
        "lists": (FieldDef("f", "checkbox_group", values=("x",)), F.array(F.col("event_type"), a.cast("string")), cut(F.array(F.upper("event_type"), b.cast("string")))),
        "tables": (table, rows(F.col("event_type"), a), cut(rows(F.upper("event_type"), b))),
        "booleans": (FieldDef("f", "boolean"), key % 2 == 0, key % 3 == 0),
        "numbers": (FieldDef("f", "float"), a, b),
    }
    return read(spark, d, "events").select("event_id", *[values_match(F.when(key % 5 != 0, x), F.when(key % 10 != 0, y), fd).alias(n) for n, (fd, x, y) in kinds.items()])


# ---------------------------------------------------------------- sources and runs

@query(r"SELECT doc_id, medicine FROM (SELECT doc_id, regexp_replace(unnest(string_split(text, ',')), '^\s+|\s+$', '', 'g') AS medicine FROM documents) t WHERE medicine <> ''")
def split_list(spark, d):
    """SRC9: comma-separated text to rows (trimmed, empty ones left out)."""
    from .sources.tables import split_rows

    return split_rows(read(spark, d, "documents"), "text", "medicine").select("doc_id", "medicine")


@query("SELECT conv_id, string_agg(role, ';' ORDER BY turn) AS files FROM conversations GROUP BY 1 HAVING count(*) = 4")
def single_page_rows(spark, d):
    """SRC10: rows whose list of files has the wanted length."""
    from .sources.tables import with_list_length

    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", "role")))["role"], ";").alias("files"))
    return with_list_length(rows, "files", ";", 4)


@query(
    """, b AS (SELECT o_orderkey AS page_id, o_orderkey % 900 AS x1, o_orderkey % 700 AS y1, o_custkey % 1000 AS x2, 800 AS y2 FROM orders)
    SELECT page_id, 'f1' AS field_name, round_even(x1 * 1653 / 1000.0, 0)::INT AS x0, round_even(y1 * 2339 / 1000.0, 0)::INT AS y0, round_even(x2 * 1653 / 1000.0, 0)::INT AS x1, round_even(y2 * 2339 / 1000.0, 0)::INT AS y1
    FROM b WHERE page_id % 3 < 2 AND round_even(x2 * 1653 / 1000.0, 0) > round_even(x1 * 1653 / 1000.0, 0)""".replace(", b AS", "WITH b AS", 1)
)
def locate_regions(spark, d):
    """SRC12: replies of a locator to page boxes."""
    from .sources.regions import located

    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    label = F.when(k % 3 == 0, "f1").when(k % 3 == 1, "label 'f1': the value").otherwise("f1 and f2")
    text = F.concat(F.lit('{"regions": [{"label": "'), label, F.lit('", "bbox_2d": ['), F.concat_ws(",", k % 900, k % 700, F.col("o_custkey") % 1000, F.lit(800)), F.lit("]}]}"))
    rows = o.select(k.alias("page_id"), text.alias("text"), F.lit(1653).alias("width_px"), F.lit(2339).alias("height_px"))
    out = located(rows, ["f1", "f2"])
    return out.select("page_id", "field_name", *[F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@query("SELECT o_orderkey AS page_id, greatest(0, x - 24) AS x0, greatest(0, y - 24) AS y0, least(1000, x + 124) AS x1, least(1200, y + 74) AS y1 FROM (SELECT o_orderkey, CAST(o_orderkey % 1000 AS INT) AS x, CAST(o_custkey % 1150 AS INT) AS y FROM orders) t")
def crop_boxes(spark, d):
    """IMG7: boxes with a margin inside the page."""
    from .sources.regions import padded

    o = read(spark, d, "orders")
    x, y = (F.col("o_orderkey") % 1000).cast("int"), (F.col("o_custkey") % 1150).cast("int")
    box = padded(F.array(x, y, x + 100, y + 50), F.lit(1000), F.lit(1200), 24)
    return o.select(F.col("o_orderkey").alias("page_id"), *[F.get(box, F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@query("SELECT event_type AS outcome, count(*) AS n, min(props) AS example FROM events GROUP BY 1")
def upload_outcomes(spark, d):
    """AGG13."""
    return store.outcomes(read(spark, d, "events").select(F.col("event_type").alias("outcome"), F.col("props").alias("detail")))


@query("SELECT user_id AS run_id, count(*) FILTER (event_type = 'view') AS pages_done, count(*) FILTER (event_type = 'click') AS fields_done, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS flagged, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1")
def run_counters(spark, d):
    """AGG14."""
    e = F.col("event_type")
    kind = F.when(e == "view", "page").when(e == "click", "field").when(e == "error", "failure").otherwise("other")
    return store.run_counters(read(spark, d, "events").select(F.col("user_id").alias("run_id"), kind.alias("kind"), (e == "purchase").cast("long").alias("flagged")))


@query("SELECT event_id AS seq, event_type FROM events WHERE event_id >= 9000")
def events_since(spark, d):
    """CUR1."""
    return store.events_since(read(spark, d, "events").select(F.col("event_id").alias("seq"), "event_type"), 9000)


@query("SELECT page_id, field_name FROM fx_gold WHERE field_name NOT IN ('f1', 'f2', 'f3', 'f4', 'f5', 'f6', 'f7', 'f8') UNION ALL SELECT g.page_id, g.field_name FROM fx_gold g JOIN fx_pages p USING (page_id) JOIN fx_field_defs f USING (field_name) WHERE f.field_page_type <> p.page_type", "gold", "pages", "field_defs")
def gold_out_of_scope(spark, d):
    """FIN7."""
    gold, pages, defs = _many(spark, d, "gold", "pages", "field_defs")
    rows = gold.join(pages.select("page_id", "page_type"), "page_id").withColumnRenamed("page_id", "pair_id")
    return invariants.gold_out_of_scope(rows, defs).withColumnRenamed("pair_id", "page_id")


@query(
    f", s AS ({_SCOPE}) SELECT s.page_id, s.field_name FROM s WHERE s.page_id IN (SELECT page_id FROM fx_gold) AND NOT EXISTS (SELECT 1 FROM fx_gold g WHERE g.page_id = s.page_id AND g.field_name = s.field_name)",
    "pages", "field_defs", "gold",
)
def gold_uncovered(spark, d):
    """FIN7: fields in scope of a page with gold that have none."""
    gold, pages, defs = _many(spark, d, "gold", "pages", "field_defs")
    return invariants.gold_uncovered(gold, pages, defs)


@query(
    """, r AS (SELECT event_id, event_id % 12 AS k, event_id % 150 AS n, trim(raw, '"') AS s FROM fx_raw_values), t AS (SELECT event_id, event_id % 5 AS k, event_id % 20 AS n FROM fx_table_values),
    a AS (SELECT event_id, 'age' AS field_name, CASE WHEN k = 6 THEN NULL WHEN k <> 0 THEN 'not an integer' WHEN n > 120 THEN 'out of range' END AS problem FROM r
    UNION ALL SELECT event_id, 'kind', CASE WHEN k = 6 THEN NULL WHEN k IN (0, 2, 3, 5, 10) OR s NOT IN ('VIEW', 'CLICK') THEN 'not a member' END FROM r
    UNION ALL SELECT event_id, 'note', CASE WHEN k = 6 THEN NULL WHEN k IN (0, 2, 3, 5, 10) THEN 'not a text' WHEN length(s) > 7 THEN 'too long' END FROM r
    UNION ALL SELECT event_id, 'meds', CASE WHEN k = 4 THEN 'not a list of rows' WHEN k IN (1, 2) THEN 'columns differ' WHEN k = 3 OR n > 15 THEN 'cell out of range' END FROM t)
    SELECT event_id, field_name, problem FROM a WHERE problem IS NOT NULL""",
    "raw_values", "table_values",
)
def gold_constraints(spark, d):
    """FIN7: values of gold against types, members, lengths, columns and ranges."""
    schema = Schema("fx", fields=(
        FieldDef("age", "integer", min=0.0, max=120.0), FieldDef("kind", "enum", values=("VIEW", "CLICK")), FieldDef("note", "string", max_length=7),
        FieldDef("meds", "table", columns=(FieldDef("drug", "string"), FieldDef("dose", "integer", max=15.0))),
    ))
    raw, tables = _many(spark, d, "raw_values", "table_values")
    rows = raw.select("event_id", F.explode(F.array(*map(F.lit, ("age", "kind", "note")))).alias("field_name"), F.col("raw").alias("gold_json"))
    rows = rows.unionByName(tables.select("event_id", F.lit("meds").alias("field_name"), F.col("raw").alias("gold_json")))
    return invariants.gold_problems(rows, schema).select("event_id", "field_name", "problem")
