"""Best-fit packing by a grouping genetic algorithm.

Documents are encoded in one pass without a shuffle; those longer than a
sequence are cut into whole sequences and a rest.  Lengths alone are packed:

* pieces are dealt at random into shards of bounded size;
* each shard is evolved on several islands, each with its own population of
  packings; the first individual is best-fit decreasing, others start from
  perturbed orders;
* crossover injects the well-filled bins of one parent into another, takes out
  the bins that hold a piece twice, and best-fits the displaced pieces;
* between rounds each island's elite migrates to the next island of its shard;
* after the last round the bins of a shard that are not well filled are
  dissolved and their pieces dealt into fewer shards, which evolve alike.

Rows are one (shard, island) each, so memory per task is bounded by the shard
size whatever the input, and no step gathers all pieces.

Defined cases: null or empty text is the end id alone; repeated rows are packed
each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stored
from .encode import encoded_blocks, encoder

CAPACITY = 2048
#: Pieces of a shard, about.
SHARD = 20_000
ISLANDS, POPULATION, GENERATIONS, ROUNDS = 2, 4, 6, 2
#: A bin with at most this share of its room free is well filled.
WELL = 0.002
#: Times that the pieces of badly filled bins are dealt anew.
LEVELS = 3


# ---------------------------------------------------------------- one shard

class Packing:
    """Bins as lists of item numbers, with the room that each has left."""

    __slots__ = ("bins", "free")

    def __init__(self, bins, free):
        self.bins, self.free = bins, free

    def fitness(self, capacity: int) -> float:
        fill = 1 - np.array(self.free, float) / capacity
        return float((fill * fill).mean()) if len(fill) else 1.0


def best_fit(items, size, capacity: int, bins: list, free: list) -> None:
    """Put items, in this order, each where the least room is left over."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for b, r in enumerate(free):
        by_room[r].append(b)
        rooms |= 1 << r
    for i in items:
        s = size[i]
        fits = rooms >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            held = by_room[r]
            b = held.pop()
            if not held:
                rooms ^= 1 << r
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
            free.append(capacity)
        r -= s
        free[b] = r
        by_room[r].append(b)
        rooms |= 1 << r


def packed(order, size, capacity: int) -> Packing:
    p = Packing([], [])
    best_fit(order, size, capacity, p.bins, p.free)
    return p


def crossover(host: Packing, donor: Packing, size, capacity: int, rng) -> Packing:
    """Whole well-filled bins of `donor` go into `host`; bins of `host` with a
    duplicate go, and so does a share of its worst; displaced items are
    best-fitted by decreasing size."""
    well = max(int(capacity * WELL), 0)
    good = np.flatnonzero(np.array(donor.free) <= well)
    if len(good):
        good = good[rng.random(len(good)) < rng.uniform(0.05, 0.3)]
    taken = {i for b in good.tolist() for i in donor.bins[b]}
    spoil = rng.random(len(host.bins)) < 0.02
    bins, free, displaced = [donor.bins[b][:] for b in good.tolist()], [donor.free[b] for b in good.tolist()], []
    for b, (held, room) in enumerate(zip(host.bins, host.free)):
        if room > well or spoil[b] or not taken.isdisjoint(held):
            displaced += [i for i in held if i not in taken]
        else:
            bins.append(held[:])
            free.append(room)
    noise = rng.uniform(0, 0.25) * rng.random(len(displaced))
    rank = np.array([size[i] for i in displaced]) * (1 - noise) if displaced else np.zeros(0)
    best_fit([displaced[k] for k in np.argsort(-rank, kind="stable").tolist()], size, capacity, bins, free)
    return Packing(bins, free)


def evolve(size: list[int], pool: list[Packing], capacity: int, generations: int, population: int, rng) -> list[Packing]:
    """The population after some generations, best first."""
    n = len(size)
    base = np.array(size, float)
    while len(pool) < population:
        wobble = rng.uniform(0, 0.2) * rng.random(n) if pool else 0.0
        pool.append(packed(np.argsort(-base * (1 - wobble), kind="stable").tolist(), size, capacity))
    pool.sort(key=lambda p: (len(p.bins), -p.fitness(capacity)))
    floor = -(-int(base.sum()) // capacity)
    for _ in range(generations):
        if len(pool[0].bins) <= floor:
            break
        a, b = rng.integers(0, min(2, len(pool))), rng.integers(0, len(pool))
        for host, donor in ((a, b), (b, a)):
            pool.append(crossover(pool[host], pool[donor], size, capacity, rng))
        pool.sort(key=lambda p: (len(p.bins), -p.fitness(capacity)))
        del pool[population:]
    return pool


def to_groups(p: Packing, n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for b, held in enumerate(p.bins):
        out[held] = b
    return out


def from_groups(groups: np.ndarray, size, capacity: int) -> Packing:
    bins: list[list[int]] = [[] for _ in range(int(groups.max()) + 1)] if len(groups) else []
    for i, b in enumerate(groups.tolist()):
        bins[b].append(i)
    return Packing(bins, [capacity - sum(size[i] for i in held) for held in bins])


# ---------------------------------------------------------------- all shards

PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """PIECES of every document; uid numbers them."""

    def run(batches):
        enc, row = encoder(tokenizer), TaskContext.get().partitionId() << 36
        for batch in batches:
            key = batch.column("doc_id")
            for i, j, bounds, ids in encoded_blocks(enc, batch.column("text"), end_id):
                total = np.diff(bounds)
                count = -(-total // capacity)
                doc = np.repeat(np.arange(j - i), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(total[doc] - start, capacity)
                view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                at = bounds[doc] + start
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(len(doc))), key.slice(i, j - i).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"],
                )
                row += len(doc)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), PIECES)


_STATE = "shard long, island int, uids array<long>, sizes array<int>, pool array<array<int>>, bins int, fitness double"


def _evolved(state: DataFrame, capacity: int, seed: int) -> DataFrame:
    """One round of each (shard, island); `pool` comes back best first."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                shard, island = row.column("shard")[0].as_py(), row.column("island")[0].as_py()
                size = row.column("sizes")[0].as_py()
                pool = [from_groups(np.array(g, np.int32), size, capacity) for g in row.column("pool")[0].as_py()]
                rng = np.random.default_rng([seed, shard, island])
                pool = evolve(size, pool, capacity, GENERATIONS, POPULATION, rng)
                groups = [to_groups(p, len(size)) for p in pool]
                yield pa.RecordBatch.from_arrays(
                    [*row.columns[:4], pa.array([groups], pa.list_(pa.list_(pa.int32()))), pa.array([len(pool[0].bins)], pa.int32()), pa.array([pool[0].fitness(capacity)])],
                    names=["shard", "island", "uids", "sizes", "pool", "bins", "fitness"],
                )

    return state.mapInArrow(lean(run), _STATE)


def _level(rest: DataFrame, shards: int, capacity: int, level: int) -> DataFrame:
    """(uid, length, shard, bin, offset, room) of every piece of `rest`."""
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(shards)))
    # A shard is a random deal of about SHARD pieces, so the list is bounded.
    rows = dealt.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("uid", "length"))).alias("p"))
    rows = rows.select(
        "shard",
        F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"),
        F.col("p.uid").alias("uids"),
        F.col("p.length").cast("array<int>").alias("sizes"),
        F.array().cast("array<array<int>>").alias("pool"),
    )
    state = stored(rows, "islands").repartition("shard", "island")
    for k in range(ROUNDS):
        if k:
            elite = state.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.element_at("pool", 1).alias("elite"))
            state = state.join(elite, ["shard", "island"]).select("shard", "island", "uids", "sizes", F.array_append("pool", F.col("elite")).alias("pool"))
        state = stored(_evolved(state.select("shard", "island", "uids", "sizes", "pool"), capacity, 1000 * level + k), "islands")
    best = state.groupBy("shard").agg(F.min_by(F.struct("uids", "sizes", F.element_at("pool", 1).alias("groups")), F.struct("bins", -F.col("fitness"), "island")).alias("b"))

    def place(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                b = batch.column("b")[r]
                uid, size, group = (np.array(b[c].as_py(), np.int64) for c in ("uids", "sizes", "groups"))
                order = np.argsort(group, kind="stable")
                uid, size, group = uid[order], size[order], group[order]
                before = np.cumsum(size) - size
                first = np.searchsorted(group, group)
                fill = np.bincount(group, size)[group].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid), pa.array(size), pa.array(np.full(len(uid), batch.column("shard")[r].as_py(), np.int64)), pa.array(group), pa.array(before - before[first]), pa.array(capacity - fill)],
                    names=["uid", "length", "shard", "bin", "offset", "room"],
                )

    return stored(best.mapInArrow(place, "uid long, length long, shard long, bin long, offset long, room long"), "placed")


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """uid, sequence_id, offset of every piece (uid, length)."""
    whole = pieces.where(F.col("length") >= capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, done = pieces.where(F.col("length") < capacity).select("uid", "length"), [whole]
    for level in range(LEVELS):
        shards = max(1, round(rest.count() / shard))
        placed = _level(rest, shards, capacity, level)
        well = F.lit(True) if shards == 1 or level == LEVELS - 1 else F.col("room") <= int(capacity * WELL)
        number = (F.lit(level).cast("long") * (1 << 58)) + F.col("shard") * (1 << 24) + F.col("bin")
        done.append(placed.where(well).select("uid", number.alias("sequence_id"), "offset"))
        if shards == 1:
            break
        rest = placed.where(~well).select("uid", "length")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Each piece of each document with its place."""
    pieces = stored(cut_pieces(docs, tokenizer, end_id, capacity), "pieces")
    out = pieces.join(pack(pieces.select("uid", "length"), capacity), "uid")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
