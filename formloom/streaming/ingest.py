"""Streaming ingest (an extension: there is no counterpart elsewhere).

Files arrive as a stream of binaryFile rows.  Each batch is set against the
documents table, so no state grows with the files seen, and a batch that is run
again adds nothing.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.run import table
from ..operators.store import append
from ..sources.files import Decoder, Prepare, accepted, ingest, with_page_images

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def start(spark: SparkSession, source: str, store: str, checkpoint: str, decoders: dict[str, Decoder], schema_id: str | None = None, once: bool = True, prepare: Prepare | None = None) -> StreamingQuery:
    """Append new files below `source` to the tables below `store`, their page
    images to `store`/images."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True).load(source)
    files = files.where(accepted(F.col("path"))).withColumn("file_hash", F.sha2("content", 256)).withColumn("doc_id", F.substring("file_hash", 1, 12))

    def batch(rows, _):
        docs, pages, _ = ingest(rows, table(spark, store, "documents"), decoders, schema_id, F.current_timestamp(), prepare)
        docs = docs.persist()
        append("pages", with_page_images(pages, f"{store}/images"), store)
        append("documents", docs, store)  # last: a document is there once its pages are
        docs.unpersist()

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
