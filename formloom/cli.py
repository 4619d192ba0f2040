"""Command line: python -m formloom.cli COMMAND ...

Tables are Parquet folders below --store.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import schema as schemas
from .functions.text import pair_id
from .images import prepared
from .netguard import assert_offline
from .operators import evaluate, finalize, store
from .operators import run as runs
from .operators.run import table
from .plans.prompts import PROMPT_VERSION
from .sources import completions, files


def session() -> SparkSession:
    return SparkSession.builder.appName("formloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _tables(spark, path):
    return {n: table(spark, path, n) for n in store.TABLES}


def status(spark, args):
    t = _tables(spark, args.store)
    counts = {k: v for k, v in t.items() if k != "meta"} | {"review_queue": store.review_queue(t["extractions"], t["pages"], t["reviews"])}
    store.table_counts(counts).show(truncate=False)


def ingest(spark, args):
    """Files to documents and pages; page images are prepared and written."""
    prepare = prepared(args.max_edge, not args.no_deskew, args.denoise)
    docs, pages, results = files.ingest(files.scan(spark, args.path), table(spark, args.store, "documents"), files.available_decoders(args.dpi), args.schema, F.current_timestamp(), prepare)
    docs, results = docs.persist(), results.persist()
    store.outcomes(results).show(truncate=False)
    store.append("pages", files.with_page_images(pages, f"{args.store}/images"), args.store)
    store.append("documents", docs, args.store)  # last: a document is there once its pages are


def _engine(url, model):
    def make():
        return completions.engine("chat_http", url=url, model=model)

    return make


def run(spark, args):
    """Ask the configured model for what pages still need."""
    config = schemas.load_config(args.config)
    make = _engine(config.engine_url, config.engine_model)
    verifier = _engine(config.verify_url or config.engine_url, config.verify_model) if config.verify_pass and config.verify_model else None
    for url, check in ((config.engine_url, make), (config.verify_url, verifier)):
        if check and url:
            assert_offline(url, config.allow_hosts)
            well, said = check().health()
            if not well:
                raise SystemExit(said)
    runs.run(spark, args.store, schemas.find_schema(config.schemas, args.schema), config, make, verifier, args.doc).show(truncate=False)


def finalize_docs(spark, args):
    """Records of documents without open flags; the others are shown."""
    runs.finalize_documents(spark, args.store, args.doc).show(args.rows, truncate=False)


def version(spark, args):
    from . import __version__

    print(f"formloom {__version__}, prompts {PROMPT_VERSION}")


def review(spark, args):
    t = _tables(spark, args.store)
    store.queue_listing(store.review_queue(t["extractions"], t["pages"], t["reviews"]), args.doc, args.field).show(args.rows, truncate=False)


def export(spark, args):
    t = _tables(spark, args.store)
    recs = t["records"].withColumn("final", F.from_json("final_json", "map<string,string>"))
    recs = store.records_to_export(recs, t["documents"], args.schema)
    (finalize.write_csv if args.format == "csv" else finalize.write_jsonl)(recs, args.out)


def score(spark, args):
    t = _tables(spark, args.store)
    gold = evaluate.load_gold(spark, args.gold)
    pairs = evaluate.pair_documents(t["documents"], pair_id(files.file_name(F.col("source_path"))))
    ext = t["extractions"].join(t["pages"].select("page_id", "doc_id"), "page_id").join(pairs, "doc_id")
    got = evaluate.newest_readings(ext.select("pair_id", "field_name", "created_at", "extraction_id", "value", "flagged", "legible"), ["pair_id", "field_name"], ["created_at", "extraction_id"])
    null = lambda c: F.nullif(F.trim(F.col(c)), F.lit("null"))
    rows = evaluate.judged(gold.withColumn("gold_value", null("gold_json")), got.withColumn("value", null("value")), ["pair_id", "field_name"], F.col("value").eqNullSafe(F.col("gold_value")))
    missing = [r.pair_id for r in evaluate.missing_pairs(gold, pairs).orderBy("pair_id").limit(100).collect()]
    print(evaluate.render_markdown(evaluate.scorecard(rows), args.set, missing))


def purge(spark, args):
    t = _tables(spark, args.store)
    left = store.purge(t, t["documents"].where(F.col("doc_id") == args.doc))
    for name in ("reviews", "regions", "extractions", "records", "pages", "documents"):
        left[name].write.mode("overwrite").parquet(f"{args.out}/{name}")


def show_schema(spark, args):
    for s in schemas.list_schemas(args.directory):
        print(f"{s.schema_id} v{s.version}: {len(s.fields)} fields, {len(s.rules)} rules")
        for f in s.fields:
            print(f"  {f.name} ({f.type}) {f.page_type or ''}")


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="formloom")
    p.add_argument("--store", default="data/store")
    sub = p.add_subparsers(dest="command", required=True)

    def command(fn, name, *options):
        c = sub.add_parser(name, help=fn.__doc__)
        for flags, kw in options:
            c.add_argument(flags, **kw)
        c.set_defaults(fn=fn)

    command(status, "status")
    command(ingest, "ingest", ("path", {}), ("--schema", {}), ("--dpi", {"type": int, "default": 200}), ("--max-edge", {"type": int, "default": 2400}), ("--no-deskew", {"action": "store_true"}), ("--denoise", {"action": "store_true"}))
    command(run, "run", ("--config", {"required": True}), ("--schema", {"required": True}), ("--doc", {}))
    command(finalize_docs, "finalize", ("--doc", {}), ("--rows", {"type": int, "default": 50}))
    command(version, "version")
    command(review, "review", ("--doc", {}), ("--field", {}), ("--rows", {"type": int, "default": 50}))
    command(export, "export", ("out", {}), ("--format", {"choices": ["csv", "jsonl"], "default": "jsonl"}), ("--schema", {}))
    command(score, "eval", ("gold", {}), ("--set", {"default": "flow"}))
    command(purge, "purge", ("doc", {}), ("out", {}))
    command(show_schema, "schema", ("directory", {}))
    args = p.parse_args(argv)
    args.fn(session(), args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
