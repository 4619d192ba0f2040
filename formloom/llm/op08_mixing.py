"""Mixing sources to target weights by soft membership.

A naive Bayes classifier over hashed words, fitted on a bounded sample of a
labelled table, gives each document posteriors over domains, so a document
counts in part for several.  Document rates r >= 0 are then fitted by projected
gradient descent on the squared distance between the expected shares of the
domains among all tokens, sum_i t_i r_i p_i / sum_i t_i, and the targets.

Distances between rates are weighted by tokens, so a step along the gradient is
r_i <- max(0, r_i - step * p_i . m), m being the misses of the shares.  A rate
is a function of p_i and the few vectors step * m: iterations keep no state,
each is one aggregation over all documents of D + 1 sums for each of a few step
lengths, and only these sums go to the driver.  Step lengths are those of
Barzilai and Borwein; the longest one tried that lowers the distance enough is
taken (the least one tried always does).  Descent ends at the targets or, where
they cannot be met, by the least squares point: where LATELY steps no longer
lower the squared distance by a thousandth.  `miss` is the largest distance that
is left.  Should neither be reached in MAX_STEPS, it is an error.

Rates have no upper bound.  The classifier's size is fixed: with more domains
words share more buckets; more than MAX_DOMAINS are an error.  Tokens are words
between white space.

Defined cases: null and empty texts have no tokens, even posteriors and rate 1;
without labelled rows there is one domain and all rates are 1; targets of
domains that were never labelled are left out and the rest rescaled, domains
without a target have target 0; repeated rows have equal rates; an empty table
has a miss of 0; other columns are kept by `mixed` and play no part.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import ASCII_SPACE, LOWER, NOT_WORD, block_views, discard, free_name, lean, span_hashes, stored, words

#: log2 of the word buckets, with up to 2**6 domains; half as many for twice as
#: many domains.
BITS = 16
#: Labelled rows that the classifier is fitted on, at most: equally many of each
#: domain, and one of each at least.
MAX_ROWS = 4000
#: Distinct domains; more are an error.
MAX_DOMAINS = 4096
#: Words of a text are not independent: its evidence, a mean over its words, is
#: weighted as that of so many independent ones (or as many as it has).
EVIDENCE = 8
#: Steps without an end are an error; those that must lower the distance.
MAX_STEPS, LATELY = 400, 40
#: Largest distance from a target, as a share of all tokens, at which steps end.
CLOSE = 1e-5


class Domains(NamedTuple):
    names: tuple[str, ...]
    #: log P(word bucket | domain), (D, buckets), and log P(domain).
    word: np.ndarray
    prior: np.ndarray


def _word_buckets(data, offsets, buckets: int):
    low = LOWER[data]
    s, e, bounds = words(low, offsets, NOT_WORD)
    return (span_hashes(low, s, e) >> np.uint64(65 - buckets.bit_length())).astype(np.int64), bounds


def _sample(labelled: DataFrame, max_rows: int) -> tuple[DataFrame, dict[str, int]]:
    """((_id, domain) of the sample, labelled rows of each domain)."""
    rows = labelled.where("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.col("domain").cast("string")).alias("domain"))
    rows = stored(rows, "labelled")
    sizes = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.domain: r.n for r in sizes.limit(MAX_DOMAINS + 1).collect()}
    if len(counts) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    each = max(max_rows // max(len(counts), 1), 1)
    # Rows of small hash alone are ranked: about twice as many as are wanted.
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    few = rows.join(F.broadcast(sizes), "domain").where(place * F.col("n") < 2 * each + 20)
    rank = F.row_number().over(Window.partitionBy("domain").orderBy(place, "_id"))
    return stored(few.withColumn("rank", rank).where(F.col("rank") <= each).select("_id", "domain"), "chosen"), counts


def fit_domains(docs: DataFrame, labelled: DataFrame, max_rows: int = MAX_ROWS) -> Domains:
    """Naive Bayes over words from `labelled` (doc_id, domain)."""
    chosen, counts = _sample(labelled, max_rows)
    names = sorted(counts) or ["all"]
    number = {n: i for i, n in enumerate(names)}
    size = 1 << BITS - max(0, (len(names) - 1).bit_length() - 6)

    def count(batches):
        table = np.zeros((len(names), size))
        for batch in batches:
            d = np.array([number[x] for x in batch.column("domain").to_pylist()], np.int64)
            for i, j, data, offsets in block_views(batch.column("text")):
                w, bounds = _word_buckets(data, offsets, size)
                np.add.at(table, (np.repeat(d[i:j], np.diff(bounds)), w), 1)
        k, b = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(b), pa.array(table[k, b])], names=["k", "b", "n"])

    rows = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(chosen), "_id").select("domain", "text")
    got = rows.mapInArrow(count, "k long, b long, n double").groupBy("k", "b").agg(F.sum("n").alias("n")).toArrow()
    k, b, n = (got.column(c).to_numpy() for c in ("k", "b", "n"))
    table = np.full((len(names), size), 0.1)
    np.add.at(table, (k, b), n)
    prior = np.array([counts.get(n, 0) + 1.0 for n in names])
    return Domains(tuple(names), np.log(table / table.sum(1, keepdims=True)).astype(np.float32), np.log(prior / prior.sum()))


def posteriors(domains: Domains, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, posteriors) of each text of a block."""
    w, bounds = _word_buckets(data, offsets, domains.word.shape[1])
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    total = np.stack([np.bincount(doc, row[w], minlength=len(n)) for row in domains.word], 1)
    score = total / np.maximum(n, 1)[:, None] * np.minimum(n, EVIDENCE)[:, None] + domains.prior * (n > 0)[:, None]
    p = np.exp(score - score.max(1, keepdims=True))
    _, _, tokens = words(data, offsets, ASCII_SPACE)
    return np.diff(tokens), p / p.sum(1, keepdims=True)


def rates(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    r = np.ones(len(p))
    for m in steps:
        r = np.maximum(r - p @ m, 0.0)
    return r


def fit_steps(memberships: DataFrame, weights: np.ndarray) -> tuple[list[np.ndarray], float]:
    """(step vectors, largest miss); `memberships` has t and p."""
    d = len(weights)
    total = memberships.agg(F.sum("t")).first()[0] or 0
    if total <= 0:
        return [], 0.0

    def sums(steps, trials):
        """(shares, squared length of the step) after each of the trial steps."""

        def run(batches):
            out = np.zeros((len(trials), d + 1))
            for batch in batches:
                t = batch.column("t").to_numpy().astype(float) / total
                p = batch.column("p").flatten().to_numpy().reshape(-1, d)
                r = rates(p, steps)
                for k, m in enumerate(trials):
                    new = np.maximum(r - p @ m, 0.0)
                    out[k, :d] += p.T @ (t * new)
                    out[k, d] += (t * (new - r) ** 2).sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], names=["i", "x"])

        out = np.zeros(len(trials) * (d + 1))
        for row in memberships.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            out[row.i] = row.x
        return [(x[:d], x[d]) for x in out.reshape(-1, d + 1)]

    steps: list[np.ndarray] = []
    ((share, _),) = sums(steps, [np.zeros(d)])
    length, past = 1.0, []
    while (miss := np.abs(share - weights).max()) > CLOSE:
        if len(steps) == MAX_STEPS:
            raise RuntimeError(f"rates do not settle: a share is {miss:.6f} off after {MAX_STEPS} steps")
        past.append(((share - weights) ** 2).sum() / 2)
        if len(past) > LATELY and min(past[-LATELY:]) > 0.999 * min(past[:-LATELY]):
            break
        # A unit step is short enough always: token shares sum to 1 and
        # posteriors are at most unit long.
        tried = sorted({max(length / k, 1.0) for k in (1, 4, 16)} | {1.0}, reverse=True)
        found = sums(steps, [x * (share - weights) for x in tried])
        for x, (new, moved) in zip(tried, found):
            if ((new - weights) ** 2).sum() / 2 <= max(past[-5:]) - 1e-4 / x * moved or x == 1.0:
                break
        steps.append(x * (share - weights))
        changed = ((new - share) ** 2).sum()
        length = min(moved / changed, 1e6) if changed > 0 else 1.0
        share = new
    return steps, float(miss)


def target_weights(domains: Domains, targets: dict[str, float]) -> np.ndarray:
    w = np.array([max(float(targets.get(n, 0.0)), 0.0) for n in domains.names])
    return w / w.sum() if w.sum() else np.full(len(w), 1 / len(w))


def fit_mixture(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> tuple[Domains, list[np.ndarray], float]:
    """(domains, step vectors, largest miss of a target)."""
    domains = fit_domains(docs, labelled)
    sent = docs.sparkSession.sparkContext.broadcast(domains)

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in block_views(batch.column("text")):
                t, p = posteriors(sent.value, data, offsets)
                d = p.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.ListArray.from_arrays(pa.array(np.arange(0, len(p) * d + 1, d, dtype=np.int32)), pa.array(p.ravel()))], names=["t", "p"])

    memberships = stored(docs.select("text").mapInArrow(lean(run), "t long, p array<double>"), "memberships")
    fitted = fit_steps(memberships, target_weights(domains, targets))
    discard(memberships)
    return domains, *fitted


def mixed_names(docs: DataFrame) -> tuple[str, str, str]:
    """Names of the columns that `mixed` adds: those of `docs` are left alone."""
    return free_name(docs, "_tokens"), free_name(docs, "_posteriors"), free_name(docs, "_rate")


def mixed(docs: DataFrame, domains: Domains, steps: list[np.ndarray]) -> DataFrame:
    """`docs` with tokens, posteriors (in the order of names) and rate."""
    names = mixed_names(docs)
    sent = docs.sparkSession.sparkContext.broadcast((domains, steps))
    fields = docs.columns

    def run(batches):
        model, vectors = sent.value
        for batch in batches:
            for i, j, data, offsets in block_views(batch.column("text")):
                t, p = posteriors(model, data, offsets)
                d = p.shape[1]
                post = pa.ListArray.from_arrays(pa.array(np.arange(0, len(p) * d + 1, d, dtype=np.int32)), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in fields), pa.array(t), post, pa.array(np.where(t > 0, rates(p, vectors), 1.0))], names=[*fields, *names]
                )

    schema = StructType([*docs.schema.fields, StructField(names[0], LongType()), StructField(names[1], ArrayType(DoubleType())), StructField(names[2], DoubleType())])
    return docs.mapInArrow(lean(run), schema)


def copies(rate, *key, seed: int = 8):
    """Whole copies whose expectation over keys is the rate."""
    share = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (share < rate - F.floor(rate)).cast("long")).cast("long")


def mixture_report(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """doc_id, n_tokens, domain (likeliest), posteriors (by domain), rate, copies
    and the fit's miss."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    domains, steps, miss = fit_mixture(rows, labelled, targets)
    out = mixed(rows, domains, steps)
    names = F.array(*map(F.lit, domains.names))
    return out.select(
        "doc_id",
        F.col("_tokens").alias("n_tokens"),
        F.element_at(names, F.array_position("_posteriors", F.array_max("_posteriors")).cast("int")).alias("domain"),
        F.map_from_arrays(names, "_posteriors").alias("posteriors"),
        F.col("_rate").alias("rate"),
        copies(F.col("_rate"), "doc_id", "text").alias("copies"),
        F.lit(miss).alias("miss"),
    )
