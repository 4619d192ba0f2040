"""Lempel-Ziv phrase fingerprints.

A text's UTF-8 bytes are parsed into dictionary phrases: each phrase is the
shortest span that is not a phrase yet.  The phrases are hashed, and the `k`
smallest hashes are the fingerprint (32 bits each, as hex).  The likeness of two
fingerprints estimates the Jaccard similarity of the phrase sets: of the `k`
smallest hashes of both together, the share that both have.

`neighbour_likeness` compares each document with its successor by doc_id and
with itself under an edit that takes text from the successor.  Documents are
dealt once, by ranges of doc_id; the first of each range is also sent to the
range before it, so no task needs another's rows.  An id that fills several
ranges is split by the first characters of its texts.  A task goes through its
range in order and holds two documents.  The edited text's parse goes on from
the state that the shared first part left.

The driver holds two numbers for each range, of which there are MAX_RANGES at
most; beyond that ranges grow, not the tasks' memory.

Defined cases: null text counts as empty; an empty text has the empty
fingerprint, like only another empty one (1.0, else 0.0); equal ids are ordered
by text; a single document is its own successor; null ids come first; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import span_hashes

K = 128
#: Text bytes in one range, about; and ranges at most (500 MB each at 100 TB).
RANGE_BYTES, MAX_RANGES = 4 << 20, 200_000
#: Characters of a text that tell rows of one doc_id apart in ranges.
PREFIX = 32


def parse_on(raw: bytes, start: int, at: int, phrases: set, ends: list) -> int:
    """Go on parsing raw[at:], the open phrase having begun at `start`."""
    new_phrase, new_end = phrases.add, ends.append
    for end in range(at + 1, len(raw) + 1):
        p = raw[start:end]
        if p not in phrases:
            new_phrase(p)
            new_end(end)
            start = end
    return start


def signature(raw: bytes, ends: list, k: int = K) -> np.ndarray:
    """The k smallest 32-bit hashes of the phrases that end at `ends`."""
    stop = np.array(ends, np.int64)
    begin = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
    h = (span_hashes(np.frombuffer(raw, np.uint8), begin, stop) >> np.uint64(32)).astype(np.uint32)
    h.sort()
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = h[1:] != h[:-1]
        h = h[keep][:k]
    return h


def likeness(x: np.ndarray, y: np.ndarray, k: int = K) -> float:
    if len(x) == 0 or len(y) == 0:
        return float(len(x) == len(y))
    both = np.concatenate([x, y])
    both.sort()
    twice = both[:-1][both[1:] == both[:-1]]
    distinct = len(both) - len(twice)
    if distinct <= k:
        return len(twice) / distinct
    keep = np.ones(len(both), bool)
    keep[1:] = both[1:] != both[:-1]
    last = both[keep][k - 1]
    return float((twice <= last).sum()) / k


def to_hex(x: np.ndarray) -> str:
    return x.astype(">u4").tobytes().hex()


def fingerprint(text: str, k: int = K) -> str:
    raw, ends = (text or "").encode(), []
    parse_on(raw, 0, 0, set(), ends)
    return to_hex(signature(raw, ends, k))


class _Document:
    """A text parsed to its middle and to its end."""

    def __init__(self, key, text: str, k: int):
        self.key, self.text, self.k = key, text, k
        self.kept = len(text) - len(text) // 2
        self.raw = text.encode()
        self.half = len(text[: self.kept].encode())
        self.phrases, self.ends = set(), []
        self.open = parse_on(self.raw[: self.half], 0, 0, self.phrases, self.ends)
        phrases, self.all_ends = set(self.phrases), list(self.ends)
        parse_on(self.raw, self.open, self.half, phrases, self.all_ends)
        self.sig = signature(self.raw, self.all_ends, k)

    def against(self, other: _Document):
        """The row of this document, `other` being its successor."""
        tail = other.text[: len(self.text) // 2].encode()
        raw = self.raw[: self.half] + tail
        ends = self.ends
        parse_on(raw, self.open, self.half, self.phrases, ends)
        sig = signature(raw, ends, self.k)
        return (
            self.key, len(self.text), hashlib.sha256(raw).hexdigest(), to_hex(self.sig), to_hex(sig),
            likeness(self.sig, sig, self.k), likeness(self.sig, other.sig, self.k),
        )


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def id_ranges(docs: DataFrame, range_bytes: int) -> tuple[np.ndarray, dict[int, list[str]]]:
    """(ends, splits): upper ends of ranges of `_key` that hold about
    `range_bytes` of text, a key that fills m of them standing m times; and for
    such keys the m - 1 prefixes of texts between their ranges."""
    total, n = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    parts = int(min(max((total or 0) // range_bytes, 1), MAX_RANGES, max(n, 1)))
    if parts < 2:
        return np.zeros(0, np.int64), {}
    shares = F.split(F.lit(",".join(f"{i / parts:.9f}" for i in range(1, parts))), ",").cast("array<double>")
    cut = docs.agg(F.percentile_approx("_key", shares, F.lit(4 * parts))).first()[0]
    ends = np.sort(np.array(cut, np.int64))
    keys, times = np.unique(ends, return_counts=True)
    many = {int(k): int(m) for k, m in zip(keys[times > 1], times[times > 1])}
    if not many:
        return ends, {}
    # About 50 texts for each of the ranges such keys fill; equal texts together.
    rows = docs.where(F.col("_key").isin(list(many))).select("_key", F.substring("text", 1, PREFIX).alias("prefix"), F.xxhash64("text").alias("h"))
    keep = min(50 * sum(many.values()) / max(n * sum(many.values()) / parts, 1), 1.0)
    found: dict[int, list[str]] = {k: [] for k in many}
    for r in rows.where(F.pmod("h", F.lit(1 << 30)) <= int(keep * (1 << 30))).select("_key", "prefix").collect():
        found[r[0]].append(r[1])
    return ends, {k: sorted(x)[len(x) // m :: max(len(x) // m, 1)][: m - 1] for (k, x), m in zip(found.items(), many.values())}


def neighbour_likeness(docs: DataFrame, k: int = K, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """SCHEMA for every document; the successor of the last is the first."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("_key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    ends, splits = id_ranges(docs.select("_key", "text"), range_bytes)

    @F.pandas_udf("int")
    def range_of(key, prefix):
        import pandas as pd

        keys = key.to_numpy()
        slot = np.searchsorted(ends, keys, side="left").astype(np.int32)
        for x, between in splits.items():
            for i in np.flatnonzero(keys == x).tolist():
                slot[i] += bisect.bisect_right(between, prefix[i])
        return pd.Series(slot)

    docs = docs.withColumn("slot", range_of("_key", F.substring("text", 1, PREFIX))) if len(ends) else docs.withColumn("slot", F.lit(0))
    first = F.struct("_key", F.substring("text", 1, PREFIX).alias("prefix"))
    # One row for each range.
    heads = sorted((r.slot, r.f["_key"], r.f["prefix"]) for r in docs.groupBy("slot").agg(F.min(first).alias("f")).collect())
    slots, head_keys, prefixes = (list(x) for x in zip(*heads)) if heads else ([], [], [])

    @F.pandas_udf("int")
    def tail_of(slot, key, prefix):
        """The range before, of rows with the key and prefix that begin theirs."""
        import pandas as pd

        at = np.searchsorted(np.array(slots), slot.to_numpy())
        head = np.array(head_keys, np.int64)[at] == key.to_numpy()
        before = np.array([slots[-1], *slots[:-1]], np.int64)[at]
        return pd.Series([b if h and prefixes[i] == p else None for h, b, i, p in zip(head.tolist(), before.tolist(), at.tolist(), prefix)], dtype="Int32")

    tail = tail_of("slot", "_key", F.substring("text", 1, PREFIX))
    sent = docs.withColumn("tail", tail).withColumn(
        "to", F.explode(F.expr("filter(array(struct(slot AS slot, false AS tail), struct(tail AS slot, true AS tail)), x -> x.slot IS NOT NULL)"))
    )
    sent = sent.select("to.slot", "to.tail", "doc_id", "_key", "text")
    dealt = sent.repartition("slot").sortWithinPartitions("slot", "tail", "_key", "text")

    def run(batches):
        slot, last, closed, out, size = None, None, False, [], 0

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), _ARROW.types)], schema=_ARROW)

        for batch in batches:
            slots, tails, keys = (batch.column(c).to_pylist() for c in ("slot", "tail", "doc_id"))
            texts = batch.column("text")
            for i in range(batch.num_rows):
                if slots[i] != slot:
                    slot, last, closed = slots[i], None, False
                if closed:  # further rows of the id that begins the next range
                    continue
                doc = _Document(keys[i], texts[i].as_py(), k)
                if last is not None:
                    out.append(last.against(doc))
                last, closed = doc, tails[i]
                if len(out) >= 500:
                    yield rows()
                    out = []
        if out:
            yield rows()

    return dealt.mapInArrow(run, SCHEMA)
