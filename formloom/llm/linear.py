"""Hashed text features and the two linear models that use them.

Models are fitted on a bounded sample of labelled rows: those with the smallest
hash of doc_id, at most `max_rows` and together at most `max_bytes` of text.
Their weights, those that are not zero of 2**bits, are sent to all executors.
Scoring reads every document once.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import ASCII_SPACE, LOWER, NOT_WORD, block_views, byte_class, lean, mix, ngrams, span_hashes, stored, words

_U64 = np.uint64
#: (bytes, offsets[, mask of features to keep]) -> (document of each feature,
#: feature), each pair once, sorted by document
Features = Callable[..., tuple[np.ndarray, np.ndarray]]


def once(doc: np.ndarray, hashed: np.ndarray, bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    feat = (hashed >> _U64(64 - bits)).astype(np.int64)
    if wanted is not None:  # features without a weight need no sorting
        use = wanted[feat]
        doc, feat = doc[use], feat[use]
    key = (doc.astype(np.int64) << bits) | feat
    key.sort()
    keep = np.ones(len(key), bool)
    keep[1:] = key[1:] != key[:-1]
    key = key[keep]
    return key >> bits, key & ((1 << bits) - 1)


def of_documents(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


# ---------------------------------------------------------------- features

#: Bytes of a word's stems.
STEMS = (4, 5, 6)


def skip_gram_features(bits: int) -> Features:
    """Words (letters, digits, non-ASCII; lower case), pairs of neighbours, pairs
    with one word between, and stems: the first STEMS bytes of longer words, so
    that inflected forms share a coordinate."""

    def features(data, offsets, wanted=None):
        low = LOWER[data]
        s, e, bounds = words(low, offsets, NOT_WORD)
        h = span_hashes(low, s, e)
        doc = of_documents(bounds)
        two, b2 = ngrams(h, bounds, 2)
        counts = np.maximum(np.diff(bounds) - 2, 0)
        b3 = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(int(b3[-1])) + np.repeat(bounds[:-1] - b3[:-1], counts)
        gap = mix(h[at] * _U64(0x2545F4914F6CDD1D) + mix(h[at + 2] + _U64(77)))
        docs, feats = [doc, of_documents(b2), of_documents(b3)], [h, two, gap]
        for k in STEMS:
            longer = np.flatnonzero(e - s > k)
            docs.append(doc[longer])
            feats.append(mix(span_hashes(low, s[longer], s[longer] + k) + _U64(9000 + k)))
        return once(np.concatenate(docs), np.concatenate(feats), bits, wanted)

    return features


_UPPER, _LOWER_OR_HIGH = byte_class(bytes(range(65, 91))), byte_class(bytes([*range(97, 123), *range(128, 256)]))
_DIGIT = byte_class(bytes(range(48, 58)))


def word_shape_features(bits: int) -> Features:
    """Indicators of n-grams (1 to 3) of words and of word shapes.

    A shape joins a word's case, its length class, its last character if that
    is no letter, and whether it repeats the word before it or the one two
    before.  A shape n-gram carries the share of the document's n-grams that
    it makes up, in steps of powers of two: mostly shouted text differs from
    text with one shouted word.
    """

    def features(data, offsets, wanted=None):
        s, e, bounds = words(data, offsets, ASCII_SPACE)
        doc, n_docs = of_documents(bounds), len(offsets) - 1
        low = LOWER[data]
        h = span_hashes(low, s, e)

        def count(kind):
            run = np.concatenate([[0], np.cumsum(kind[data])])
            return run[e] - run[s]

        size = e - s
        upper, lower, digit = count(_UPPER), count(_LOWER_OR_HIGH), count(_DIGIT)
        case = np.select([(upper == 0) & (lower == 0), upper == 0, (upper == 1) & (lower > 0), lower == 0], [0, 1, 2, 3], 4)
        last = data[e - 1].astype(np.int64) if len(e) else np.zeros(0, np.int64)
        last = np.where((_UPPER | _LOWER_OR_HIGH)[last], 0, last)
        other = np.minimum(size - upper - lower - digit, 3)
        back1, back2 = np.zeros(len(h), bool), np.zeros(len(h), bool)
        back1[1:], back2[2:] = h[1:] == h[:-1], h[2:] == h[:-2]
        length = np.minimum(np.log2(np.maximum(size, 1)).astype(np.int64), 6)
        shape = mix(((((case * 8 + length) * 256 + last) * 4 + other) * 4 + back1 + 2 * back2).astype(_U64))
        coarse = mix((((case * 4 + other) * 4 + back1 + 2 * back2) * 2 + (digit > 0)).astype(_U64) + _U64(1 << 40))
        docs, feats = [doc], [h]
        two, b2 = ngrams(h, bounds, 2)
        docs.append(of_documents(b2))
        feats.append(two)
        total = np.maximum(np.diff(bounds), 1)
        for base, top in ((shape, 2), (coarse, 3)):
            for n in range(1, top + 1):
                g, gb = ngrams(base, bounds, n)
                d = of_documents(gb)
                # Count equal (document, n-gram) pairs, then tag with the share.
                order = np.lexsort((g, d))
                d, g = d[order], g[order]
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(g)))
                d, g = d[at], g[at]
                share = np.ceil(-np.log2(times / total[d])).astype(np.int64)
                for step in range(0, 5):  # share of at least 2**-step: cumulative, so near values share features
                    w = share <= step
                    docs.append(d[w])
                    feats.append(mix(g[w] + _U64(1000 * n + step)))
        extra = [np.minimum(np.log2(total).astype(np.int64), 12)]
        docs.append(np.arange(n_docs))
        feats.append(mix(extra[0].astype(_U64) + _U64(1 << 50)))
        return once(np.concatenate(docs), np.concatenate(feats), bits, wanted)

    return features


# ---------------------------------------------------------------- samples

def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_bytes: int, fold: int = 5) -> DataFrame:
    """_id, text and y of labelled documents, none of the held-out fold; the
    same rows for the same tables.

    They are taken in the order of their hash while they are at most `max_rows`
    with at most `max_bytes` of text; one is taken whatever its length.  A
    doc_id whose labels disagree counts by their mean; of unlike documents with
    one doc_id, that with the smallest hash of its text counts.
    """
    marked = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (held_out(F.col("doc_id"), fold) == F.lit(False)))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    )
    chosen = stored(marked.orderBy(F.xxhash64("_id"), "_id").limit(max_rows), "marked")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").alias("_id"), text.alias("text"), F.xxhash64(text).alias("_h"))
    sizes = rows.join(F.broadcast(chosen), "_id").groupBy("_id", "y").agg(F.min(F.struct("_h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))).alias("t"))
    # At most max_rows rows without their texts, so one window over them is small.
    before = F.sum("t.n").over(Window.orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, -1))
    total = F.coalesce(before, F.lit(0)) + F.col("t.n")
    kept = sizes.select("_id", "y", F.col("t._h").alias("_h"), F.col("t.n").alias("_n"), total.alias("_total")).where((F.col("_total") <= max_bytes) | (F.col("_total") == F.col("_n")))
    kept = stored(kept.select("_id", "y", "_h"), "sample")
    return rows.join(F.broadcast(kept), ["_id", "_h"]).select("_id", "text", "y").dropDuplicates(["_id"])


def held_out(doc_id, fold: int = 5):
    return F.crc32(doc_id.cast("string").cast("binary")) % fold == 0


def sample_matrix(rows: DataFrame, features: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, features, y) of the bounded training rows, in order of id."""

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in block_views(batch.column("text")):
                doc, feat = features(data, offsets)
                b = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(i, j - i), batch.column("y").slice(i, j - i), pa.ListArray.from_arrays(pa.array(b), pa.array(feat.astype(np.int32)))],
                    names=["_id", "y", "f"],
                )

    got = rows.mapInArrow(lean(run), "_id long, y int, f array<int>").toArrow()
    order = np.argsort(got.column("_id").to_numpy(), kind="stable")
    sizes = np.concatenate([np.zeros(0, np.int64), *(c.value_lengths().to_numpy() for c in got.column("f").chunks)])
    bounds = np.concatenate([[0], np.cumsum(sizes[order])]).astype(np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = bounds[:-1]
    feat, row = np.empty(int(bounds[-1]), np.int32), 0
    for chunk in got.column("f").chunks:  # row by row: no second copy of all at once
        values, at = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        for k in range(len(chunk)):
            feat[place[row] : place[row] + at[k + 1] - at[k]] = values[at[k] : at[k + 1]]
            row += 1
    return bounds, feat, got.column("y").to_numpy()[order].astype(float)


# ---------------------------------------------------------------- models

def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_platt(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """a, b of P(y=1) = sigmoid(a * margin + b), by Newton's method with
    smoothed targets."""
    pos, neg = float((y > 0.5).sum()), float((y <= 0.5).sum())
    t = np.where(y > 0.5, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(rounds):
        p = sigmoid(a * margin + b)
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - t) * margin).sum() + 1e-3 * (a - 1), (p - t).sum()])
        hess = np.array([[(w * margin**2).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return max(float(a), 1e-6), float(b)


class Weights(NamedTuple):
    """Columns of weights at the features `index`, zero elsewhere, and a bias."""

    index: np.ndarray
    columns: np.ndarray
    bias: float

    @classmethod
    def of(cls, bias: float, *columns: np.ndarray) -> Weights:
        index = np.flatnonzero(np.any(columns, axis=0)).astype(np.int32)
        return cls(index, np.array(columns, np.float32)[:, index], float(bias))

    def dense(self, bits: int) -> np.ndarray:
        out = np.zeros((len(self.columns), 1 << bits), np.float32)
        out[:, self.index] = self.columns
        return out

    def wanted(self, bits: int) -> np.ndarray:
        out = np.zeros(1 << bits, bool)
        out[self.index] = True
        return out


def fit_nbsvm(bounds, feat, y, bits: int, alpha: float = 1.0, cost: float = 0.3, rounds: int = 12, seed: int = 7) -> Weights:
    """Weights and ratios for unit-length indicator rows: class log-count ratios
    times a linear hinge-loss model found by dual coordinate descent."""
    size, n = 1 << bits, len(y)
    sign = np.where(y > 0.5, 1.0, -1.0)
    row = np.repeat(np.arange(n), np.diff(bounds))
    p = alpha + np.bincount(feat[sign[row] > 0], minlength=size)
    q = alpha + np.bincount(feat[sign[row] < 0], minlength=size)
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[(p + q) == 2 * alpha] = 0  # never met
    x = ratio[feat]
    norm = np.sqrt(np.add.reduceat(np.append(x * x, 0), bounds[:-1]) * (np.diff(bounds) > 0)) if n else np.zeros(0)
    x = x / np.maximum(norm, 1e-12)[row]
    # Rarer class: costs in inverse proportion to its share.
    share = np.where(sign > 0, max((sign > 0).mean(), 1e-9), max((sign < 0).mean(), 1e-9)) if n else sign
    upper = cost * 0.5 / share
    w, bias = np.zeros(size), 0.0
    dual, order = np.zeros(n), np.arange(n)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        rng.shuffle(order)
        worst = 0.0
        for i in order:
            a, b = bounds[i], bounds[i + 1]
            f, v = feat[a:b], x[a:b]
            g = sign[i] * (w[f] @ v + bias) - 1
            new = min(max(dual[i] - g / 2.0, 0.0), upper[i])  # unit rows with a bias of 1: norm 2
            step = new - dual[i]
            if step:
                dual[i] = new
                w[f] += step * sign[i] * v
                bias += step * sign[i]
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return Weights.of(bias, w, ratio)


def nbsvm_margins(columns: np.ndarray, bias: float, doc, feat, n: int) -> np.ndarray:
    w, ratio = columns
    r = ratio[feat].astype(float)
    dot = np.bincount(doc, r * w[feat], minlength=n)
    norm = np.sqrt(np.bincount(doc, r * r, minlength=n))
    return dot / np.maximum(norm, 1e-12) + bias


#: Chosen on folds of the training rows, never on the held-out one.  0.1 GB table
#: (fold 1 of crc32 mod 5, 8,000 rows for fitting): of rounds 5, 10, 20 and l1
#: 0.5, 2, 5, 20, five rounds and 5 had a log loss of 0.0056 (0.0054 to 0.28 in
#: all) in the least time.  sf0.1 (folds 1 to 4 in turn, 2,400 rows): log loss
#: 0.074 with 18 bits, 0.065 with 20; recall of toxic rows 0.82 to 0.85.
FTRL_ROUNDS, FTRL_L1 = 5, 5.0


def fit_ftrl(bounds, feat, y, bits: int, alpha=2.0, beta=1.0, l1=None, l2=1.0, rounds: int = FTRL_ROUNDS, seed: int = 11) -> Weights:
    """FTRL-proximal logistic regression over indicator rows.  Each coordinate
    has its own rate; l1 (by default FTRL_L1, less for fewer than 200 rows)
    leaves most weights at zero."""
    size, n = 1 << bits, len(y)
    l1 = min(FTRL_L1, n / 40) if l1 is None else l1
    z, acc = np.zeros(size + 1), np.zeros(size + 1)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(n):
            f = np.append(feat[bounds[i] : bounds[i + 1]], size)
            zf, nf = z[f], acc[f]
            lam = np.where(f == size, 0.0, l1)
            w = np.where(np.abs(zf) <= lam, 0.0, -(zf - np.sign(zf) * lam) / ((beta + np.sqrt(nf)) / alpha + l2))
            g = float(sigmoid(w.sum())) - y[i]
            z[f] = zf + g - (np.sqrt(nf + g * g) - np.sqrt(nf)) / alpha * w
            acc[f] = nf + g * g
    lam = np.append(np.full(size, l1), 0.0)
    w = np.where(np.abs(z) <= lam, 0.0, -(z - np.sign(z) * lam) / ((beta + np.sqrt(acc)) / alpha + l2))
    return Weights.of(w[-1], w[:-1])


def ftrl_margins(columns: np.ndarray, bias: float, doc, feat, n: int) -> np.ndarray:
    return np.bincount(doc, columns[0][feat].astype(float), minlength=n) + bias


# ---------------------------------------------------------------- scoring

def scored(docs: DataFrame, features: Features, margins, weights: Weights, bits: int, a: float = 1.0, b: float = 0.0, text: str = "text", score: str = "score") -> DataFrame:
    """`docs` with a score, from `text` alone (null: empty); features without a
    weight are left out."""
    sent = docs.sparkSession.sparkContext.broadcast((weights, a, b))
    fields = docs.columns

    def run(batches):
        model, slope, shift = sent.value
        columns, wanted = model.dense(bits), model.wanted(bits)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, j, data, offsets in block_views(batch.column(text)):
                doc, feat = features(data, offsets, wanted)
                out[i:j] = sigmoid(slope * margins(columns, model.bias, doc, feat, j - i) + shift)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in fields), pa.array(out)], names=[*fields, score])

    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields, StructField(score, DoubleType())]))
