"""What the operators share: scratch tables, Arrow text access, hashing.

All Python work is done on Arrow batches.  Texts are read as (bytes, offsets)
views of the Arrow buffers, in blocks of bounded size, and words are found and
hashed with whole-array numpy operations.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that are worked on at once (a longer text makes a block alone).
BLOCK_BYTES = 1 << 20

_U64 = np.uint64


# ---------------------------------------------------------------- tables

def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder `spark.checkpoint.dir`.

    Only a local session without that setting (tests) gets a folder made here;
    on a cluster the executors could not see it, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("formloom.scratch.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="formloom-")
        spark.conf.set("formloom.scratch.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: lineage ends there."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `stored` gave, once nothing reads them any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def lean(run):
    """A batch function that gives freed memory back when its partition ends:
    Python workers are used again, and hold what they once held otherwise."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not glibc
            pass

    return wrapped


# ---------------------------------------------------------------- Arrow text

def text_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32, len(col) + 1 + col.offset)
    offsets = offsets[col.offset :].astype(np.int64)
    if data is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return np.frombuffer(data, np.uint8)[lo:hi], offsets - lo


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together have about `limit` bytes."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def block_views(col: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for each block of a column."""
    data, offsets = text_view(col)
    for i, j in blocks(offsets, limit):
        lo, hi = offsets[i], offsets[j]
        yield i, j, data[lo:hi], offsets[i : j + 1] - lo


# ---------------------------------------------------------------- hashing

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and odd multipliers)."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


_BYTE_CODE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U64(2) + _U64(1)
_STEP = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = [np.ones(1, _U64), np.ones(1, _U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the odd step, and of its inverse mod 2**64."""
    if len(_POWERS[0]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            p = np.full(m, base, _U64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray = _BYTE_CODE) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end): equal bytes, equal hashes."""
    if not len(starts):
        return np.zeros(0, _U64)
    up, down = _powers(len(data) + 1)
    run = np.zeros(len(data) + 1, _U64)
    np.cumsum(code[data] * up[: len(data)], out=run[1:])
    h = (run[ends] - run[starts]) * down[starts]
    h += (ends - starts).astype(_U64) * _U64(0xD6E8FEB86659FD93)
    return mix(h)


def byte_class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Space and \x09-\x0D.
ASCII_SPACE = byte_class(b" \t\n\x0b\x0c\r")
#: What separates words of letters, digits and non-ASCII characters.
NOT_WORD = byte_class(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal spans without `gap` bytes, and how many
    of them come before each document; no word crosses a document's end."""
    n = len(data)
    inside = ~gap[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < n]
    first[at] = inside[at]
    last = inside
    last = last.copy()
    last[:-1] &= ~inside[1:] if n else True
    stop = offsets[1:][offsets[1:] > 0] - 1
    last[stop] = inside[stop]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def ngrams(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n consecutive words, and their bounds by document."""
    counts = np.diff(bounds)
    have = np.maximum(counts - n + 1, 0)
    out_bounds = np.concatenate([[0], np.cumsum(have)])
    at = np.arange(int(out_bounds[-1])) + np.repeat(bounds[:-1] - out_bounds[:-1], have)
    x = np.zeros(len(at), _U64)
    for k in range(n):
        x = mix(x * _U64(0xC2B2AE3D27D4EB4F) + h[at + k] + _U64(n)) if n > 1 else h[at + k]
    return x, out_bounds
