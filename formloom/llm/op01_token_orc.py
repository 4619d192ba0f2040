"""Token-ID output in ORC.

Documents are dealt into ranges of ascending doc_id (nulls first; equal ids by
text, whose first characters are part of the range, so an id that many rows
share is no range of its own), so that the files in name order hold the corpus
in id order.  Each task
encodes its documents and hands rows to Spark's ORC writer: the ids are an
integer column with ORC's run-length encoding, row indexes come with every
`index_stride` rows, and `doc_id` has a Bloom filter.  Readers prune stripes and
row groups by doc_id without touching ids, and split files by stripe.

Defined cases: null or empty text gives the end id alone; a special token's
string in a text gives its id, as the tokenizer's own call does; repeated rows give
repeated rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, scratch
from .encode import encoded_blocks, encoder

#: Characters of a text that tell rows of one doc_id apart in ranges.
PREFIX = 48
SCHEMA = "part int, row long, doc_id long, part_start long, n_tokens long, ids array<int>"
_ARROW = pa.schema(
    [("part", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))]
)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Rows of SCHEMA in ascending doc_id: part is the range, part_start counts
    the ids before the document in its range."""

    def run(batches):
        enc, part, row, start = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            key = batch.column("doc_id")
            for i, j, bounds, ids in encoded_blocks(enc, batch.column("text"), end_id):
                n = j - i
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(np.arange(row, row + n)),
                        key.slice(i, n),
                        pa.array(start + bounds[:-1]),
                        pa.array(np.diff(bounds)),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
                    ],
                    schema=_ARROW,
                )
                row, start = row + n, start + int(bounds[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.repartitionByRange("doc_id", F.substring("text", 1, PREFIX)).sortWithinPartitions("doc_id", "text").mapInArrow(lean(run), SCHEMA)


def write_token_orc(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    stripe_bytes: int = 64 << 20,
    index_stride: int = 1000,
    bloom_fpp: float = 0.01,
) -> None:
    (
        encode_documents(docs, tokenizer, end_id)
        .write.option("compression", "zstd")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", index_stride)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", bloom_fpp)
        .orc(path)
    )


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """SCHEMA with `start`, the ids of all documents before each."""
    rows = spark.read.schema(SCHEMA).orc(path)
    # One row for each file, so the window over all of them is small.
    ends = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = ends.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("part_start")).drop("base")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Documents by id; the predicate reaches ORC's statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def crc32_of_ids(rows: DataFrame, keep: list[str], ids: str = "ids") -> DataFrame:
    """`keep` and ids_crc32, of the ids as little-endian unsigned 32-bit numbers."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", ids_crc32 long"

    def run(batches):
        for batch in batches:
            col = batch.column(ids)
            flat, off = np.ascontiguousarray(col.values.to_numpy(zero_copy_only=False), "<u4"), col.offsets.to_numpy()
            view = memoryview(flat).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(crc, pa.int64())], names=[*keep, "ids_crc32"])

    return rows.select(*keep, ids).mapInArrow(run, schema)


def token_orc_digest(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write, read back, and digest: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = scratch(spark, "token-orc")
    write_token_orc(docs, path, tokenizer, end_id)
    return crc32_of_ids(read_token_orc(spark, path), ["doc_id", "start", "n_tokens"])
