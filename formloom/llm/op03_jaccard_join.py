"""N-gram Jaccard join: near duplicates by shared word shingles.

A document's set holds its distinct `n`-word shingles as 64-bit hashes.  Equal
sets (by two independent 64-bit hashes, v and w) are one vertex, kept once.

1. One pass makes each document's set size and set hashes.
2. One pass sends every shingle of every kept set, packed to a few bytes, to
   buckets, which count in how many sets each stands.  Only shared shingles
   come back to the block of documents they are from.  There each set is
   ordered rare first: those of no other set, then by frequency.  Of its prefix
   (size - ceil(t * size) + 1) the shared part is emitted; a set with enough
   shingles of its own has none and is out.
3. Sets joined by prefix keys, through the first set of each key, are candidate
   groups (contraction to components); linked sets always share a group.  Each
   set of a group is sent once to the group's task.  There prefix keys give
   candidates, which length, positional and suffix filters thin out; those left
   are verified once by exact intersection: linked when denominator * inter >=
   numerator * union.  Links are followed outward, so pairs inside what is
   already linked need no check.
4. A group with more than GROUP_KEYS keys is dealt in rounds: each set goes to
   one unit, that of its smallest prefix key in an order hashed anew for the
   round (salted where the unit is too large), so a round sends each set once.
   After a round, keys whose sets are all connected already are done with; what
   falls apart into smaller groups is compared as these.  Keys that join unlike
   components after ROUNDS rounds are compared key by key.
5. The links, at most one for each set and unit, are contracted to components.

Blocks, buckets and units have a bounded size; nothing gathers the sets of one
shingle, and no pairs are written.

Defined cases: null text, no words: empty set, linked with nothing, its own
component; fewer than `n` words: the sequence is the one shingle; repeated rows
are one vertex; rows that share a doc_id with other text are judged each by its
own text; a null doc_id takes part and counts as largest; other columns are
ignored; an empty table gives no rows; a text of any length is one set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, LOWER, block_views, discard, lean, mix, ngrams, span_hashes, stored, words
from .components import components

_U64 = np.uint64
#: Shingles in one bucket and in one block of step 2, about.
BUCKET_KEYS = 1_000_000
BLOCK_KEYS = 1_000_000
#: Bits of a shingle's hash that are sent, besides those that choose the bucket.
SENT_BYTES = 5
#: log2 of the slots in the map of documents that a pass looks at, at most
#: (32 MB); where it would be more than half full, ids are joined instead.
SLOT_BITS = 28
#: Keys of all sets that one task compares, at most.
GROUP_KEYS = 2_000_000
#: Rounds in which the sets of larger groups are dealt once each.
ROUNDS = 4
#: Rows of a few numbers each (40 MB) that are sent to all executors, at most.
SENT_ROWS = 500_000
#: Stands for a null doc_id inside.
NO_ID = (1 << 63) - 1


def shingle_sets(data, offsets, n: int):
    """(keys, bounds): the sorted distinct shingle hashes of each document."""
    low = LOWER[data]
    s, e, bounds = words(low, offsets, ASCII_SPACE)
    h = span_hashes(low, s, e)
    g, gb = ngrams(h, bounds, n)
    count = np.diff(bounds)
    docs = np.repeat(np.arange(len(count)), np.diff(gb))
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = []
        for d in short:
            x = np.array([1234567], _U64)
            for w in h[bounds[d] : bounds[d + 1]]:
                x = mix(x * _U64(0xC2B2AE3D27D4EB4F) + w + _U64(99))
            whole.append(x[0])
        g, docs = np.concatenate([g, np.array(whole, _U64)]), np.concatenate([docs, short])
    order = np.lexsort((g, docs))
    g, docs = g[order], docs[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (docs[1:] != docs[:-1])
    g, docs = g[keep], docs[keep]
    return g, np.searchsorted(docs, np.arange(len(count) + 1))


def set_hash(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes (v, w) of each set."""
    size = np.diff(bounds).astype(_U64)

    def one(salt: int) -> np.ndarray:
        run = np.zeros(len(g) + 1, _U64)
        np.cumsum(mix(g ^ _U64(salt)), out=run[1:])
        return mix(run[bounds[1:]] - run[bounds[:-1]] + size)

    return np.column_stack([one(0x5DEECE66D), one(0x2545F4914F6CDD1D)]).view(np.int64)


def prefix_size(size, num: int, den: int):
    """Keys of a set of `size` among which one is shared with any linked set."""
    return np.where(size > 0, size - -(-num * size // den) + 1, 0)


def _profile(docs: DataFrame, n: int) -> DataFrame:
    """Step 1: (id, h, size, v, w) of each document."""

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in block_views(batch.column("text")):
                g, bounds = shingle_sets(data, offsets, n)
                vw = set_hash(g, bounds)
                kept = [batch.column(c).slice(i, j - i) for c in ("id", "h")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(bounds)), pa.array(vw[:, 0]), pa.array(vw[:, 1])], names=["id", "h", "size", "v", "w"])

    return docs.select("id", "h", "text").mapInArrow(lean(run), "id long, h long, size long, v long, w long")


def _slot(c, bits: int):
    """Bitmap functions count from 1."""
    return F.pmod(F.xxhash64(c), F.lit(1 << bits)) + 1


def _slots_of(ids: DataFrame, bits: int):
    """A broadcast bit map, of fixed size, of the slots of column id: what is not
    in it is not among the ids."""
    maps = ids.select(_slot("id", bits).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
    table = np.zeros(max((1 << bits) // 8, 4096), np.uint8)
    for r in maps.collect():  # at most 2**bits / 32768 rows of 4 KB
        lo = (r.k - 1) * 4096
        table[lo : lo + 4096] = np.frombuffer(bytes(r.m), np.uint8)
    return ids.sparkSession.sparkContext.broadcast(table)


def _rows_of(docs: DataFrame, ids: DataFrame):
    """(rows, bits): rows (slot, text) that have all documents of `ids`, and the
    map that tells most others; without a map (null), they are the ids' own."""
    count = ids.count()
    if 2 * count <= 1 << SLOT_BITS:
        # 256 slots and more for each id, as long as the map may grow.
        bits = min(max(17, (256 * count).bit_length()), max(17, SLOT_BITS))
        return docs.select(_slot("id", bits).alias("slot"), "text"), _slots_of(ids, bits)
    return docs.join(ids.select("id").distinct(), "id", "left_semi").select(F.lit(1).cast("long").alias("slot"), "text"), None


def _own_sets(batches, bits: np.ndarray | None, n: int):
    """(vw, g, bounds) of the sets that this task meets first, of rows whose slot
    is marked in the bit map."""
    seen: set[bytes] = set()
    for batch in batches:
        if bits is not None:
            s = batch.column("slot").to_numpy() - 1
            batch = batch.filter(pa.array((bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1))
        for i, j, data, offsets in block_views(batch.column("text")):
            g, bounds = shingle_sets(data, offsets, n)
            vw, size = set_hash(g, bounds), np.diff(bounds)
            fresh = np.zeros(len(vw), bool)
            for k, x in enumerate(np.ascontiguousarray(vw).view("V16").ravel().tolist()):
                if size[k] and x not in seen:
                    seen.add(x)
                    fresh[k] = True
            keep = np.repeat(fresh, size)
            yield vw[fresh], g[keep], np.concatenate([[0], np.cumsum(size[fresh])])


_POSTING = pa.schema([("key", pa.int64()), ("v", pa.int64()), ("size", pa.int32())])
_SENT = pa.schema([("route", pa.int32()), ("block", pa.int64()), ("doc", pa.binary()), ("key", pa.binary()), ("level", pa.binary())])


def _postings(docs: DataFrame, keeper: DataFrame, n: int, num: int, den: int, n_buckets: int) -> DataFrame:
    """Step 2: the shared keys of each set's prefix."""
    rows, bits = _rows_of(docs, keeper)
    low_bits = _U64((1 << 8 * SENT_BYTES) - 1)

    def send(batches):
        """Rows of a block and bucket: doc has pairs of a document and how many
        keys it has there, key their hashes.  The block's own row has v, w and
        sizes."""
        held, count, block = [], 0, TaskContext.get().partitionId() << 24

        def flush():
            vw, g, size = (np.concatenate(x) for x in zip(*held))
            doc, h = np.repeat(np.arange(len(vw)), size), mix(g)
            bucket, rest = (h % _U64(n_buckets)).astype(np.int64), (h // _U64(n_buckets)) & low_bits
            order = np.argsort(bucket, kind="stable")
            bucket, doc, rest = bucket[order], doc[order], rest[order]
            edge = np.searchsorted(bucket, np.arange(n_buckets + 1))
            run = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])]))
            pairs = np.column_stack([doc[run], np.diff(np.append(run, len(doc)))]).astype(np.uint32)
            first = np.searchsorted(run, edge)
            full = np.flatnonzero(np.diff(edge))
            for at in range(0, len(full), 256):
                part = full[at : at + 256]
                docs_of = [pairs[first[b] : first[b + 1]].tobytes() for b in part]
                keys = [np.ascontiguousarray(rest[edge[b] : edge[b + 1]].view(np.uint8).reshape(-1, 8)[:, :SENT_BYTES]).tobytes() for b in part]
                m = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(np.full(m, block)), pa.array(docs_of, pa.binary()), pa.array(keys, pa.binary()), pa.nulls(m, pa.binary())], schema=_SENT)
            own = [pa.array([n_buckets + block % n_buckets], pa.int32()), pa.array([block]), pa.array([vw.tobytes()], pa.binary()), pa.array([size.astype(np.int64).tobytes()], pa.binary()), pa.nulls(1, pa.binary())]
            yield pa.RecordBatch.from_arrays(own, schema=_SENT)

        for vw, g, bounds in _own_sets(batches, bits and bits.value, n):
            held.append((vw, g, np.diff(bounds)))
            count += len(g)
            if count >= BLOCK_KEYS:
                yield from flush()
                held, count, block = [], 0, block + 1
        if count:
            yield from flush()

    def settle(batches):
        """Of each bucket, the keys that stand more than once, with log levels of
        their counts, as rows of their blocks."""
        now, rows = None, []

        def done():
            keys, docs_of, source = [], [], []
            for k, (_, doc, key) in enumerate(rows):
                number, times = np.frombuffer(doc, np.uint32).reshape(-1, 2).T
                raw = np.zeros((len(key) // SENT_BYTES, 8), np.uint8)
                raw[:, :SENT_BYTES] = np.frombuffer(key, np.uint8).reshape(-1, SENT_BYTES)
                keys.append(raw.view(_U64).ravel())
                docs_of.append(np.repeat(number.astype(np.int32), times))
                source.append(np.full(len(raw), k, np.int32))
            key, doc, source = map(np.concatenate, (keys, docs_of, source))
            order = np.argsort(key, kind="stable")
            key, doc, source = key[order], doc[order], source[order]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            times = np.diff(np.append(start, len(key)))
            many = np.repeat(times > 1, times)
            level = np.repeat(np.minimum(np.floor(4 * np.log2(times)), 255).astype(np.uint8), times)[many]
            key, doc, source = key[many] * _U64(n_buckets) + _U64(now), doc[many], source[many]
            order = np.argsort(source, kind="stable")
            key, doc, level = key[order], doc[order], level[order]
            edge = np.searchsorted(source[order], np.arange(len(rows) + 1))
            full = np.flatnonzero(np.diff(edge))
            cut = lambda x: pa.array([x[edge[k] : edge[k + 1]].tobytes() for k in full], pa.binary())
            return pa.RecordBatch.from_arrays([pa.nulls(len(full), pa.int32()), pa.array([rows[k][0] for k in full], pa.int64()), cut(doc), cut(key), cut(level)], schema=_SENT)

        for batch in batches:
            route = batch.column("route").to_numpy()
            own = batch.filter(pa.array(route >= n_buckets))
            if own.num_rows:
                yield own
            for k in np.flatnonzero(route < n_buckets).tolist():
                if route[k] != now:
                    if rows:
                        yield done()
                    now, rows = int(route[k]), []
                rows.append((batch.column("block")[k].as_py(), batch.column("doc")[k].as_py(), batch.column("key")[k].as_py()))
        if rows:
            yield done()

    def prefixes(batches):
        """Shared keys of the prefixes of a block's sets; the block's own row
        (route not null) comes first or last."""
        now, own, rows = None, None, []

        def done():
            vw, size = np.frombuffer(own[0], np.int64).reshape(-1, 2), np.frombuffer(own[1], np.int64)
            doc, key, level = (np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, t in enumerate((np.int32, _U64, np.uint8)))
            order = np.lexsort((key, level, doc))
            doc, key = doc[order], key[order]
            shared = np.bincount(doc, minlength=len(size))
            alone = size - shared
            take = np.clip(prefix_size(size, num, den) - alone, 0, shared)
            first = np.cumsum(shared) - shared
            at = np.arange(take.sum()) + np.repeat(first - np.cumsum(take) + take, take)
            d = doc[at]
            for lo in range(0, len(at), 100_000):
                w = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[at[w]].view(np.int64)), pa.array(vw[d[w], 0]), pa.array(size[d[w]].astype(np.int32))], schema=_POSTING)

        for batch in batches:
            for route, block, doc, key, level in zip(*(c.to_pylist() for c in batch.columns)):
                if block != now:
                    if rows:
                        yield from done()
                    now, own, rows = block, None, []
                if route is None:
                    rows.append((doc, key, level))
                else:
                    own = (doc, key)
        if rows:
            yield from done()

    schema = "route int, block long, doc binary, key binary, level binary"
    sent = rows.mapInArrow(lean(send), schema).repartition("route").sortWithinPartitions("route")
    back = sent.mapInArrow(lean(settle), schema).repartition("block").sortWithinPartitions("block")
    return stored(back.mapInArrow(lean(prefixes), "key long, v long, size int"), "postings")


def linked_roots(bodies: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """For each set of hashes, the number of a set that it is linked with by a
    chain.

    Keys are ordered rare first by their counts here.  From each set not reached yet its links
    are followed; a set that was reached is never a candidate again, so no pair
    is verified twice and pairs inside what is already linked not at all.
    """
    n = len(bodies)
    size = np.array([len(b) for b in bodies], np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(n), size)
    _, number, times = np.unique(np.concatenate(bodies) if n else np.zeros(0, _U64), return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    flat = rank[number]
    flat = flat[np.lexsort((flat, owner))]
    want = prefix_size(size, num, den)
    doc = np.repeat(np.arange(n), want)
    pos = np.arange(want.sum()) - np.repeat(np.cumsum(want) - want, want)
    key = flat[start[doc] + pos]
    first_of = np.concatenate([[0], np.cumsum(want)])
    # Suffix filter: between the same pivots two sets cannot share more keys
    # than the smaller of their numbers there.
    part = flat * 9 // max(len(times), 1)
    spread = np.bincount(owner * 9 + part, minlength=9 * n).reshape(n, 9)

    def lists(alive):
        use = np.flatnonzero(alive[doc])
        use = use[np.argsort(key[use], kind="stable")]
        return doc[use], pos[use], np.searchsorted(key[use], np.arange(len(times) + 1))

    root, alive, held = np.arange(n), np.ones(n, bool), n
    docs_at, pos_at, edge = lists(alive)
    for s in np.argsort(size, kind="stable").tolist():
        if not alive[s]:
            continue
        alive[s] = False
        stack = [s]
        while stack:
            x = stack.pop()
            keys = key[first_of[x] : first_of[x + 1]]
            count = edge[keys + 1] - edge[keys]
            if not count.sum():
                continue
            at = np.arange(count.sum()) + np.repeat(edge[keys] - np.cumsum(count) + count, count)
            y, room_x, room_y = docs_at[at], size[x] - np.repeat(np.arange(len(keys)), count), pos_at[at]
            ok = alive[y]
            y, room_x, room_y = y[ok], room_x[ok], size[y[ok]] - room_y[ok]
            need = -(-num * (size[x] + size[y]) // (num + den))
            ok = (den * size[y] >= num * size[x]) & (den * size[x] >= num * size[y]) & (np.minimum(room_x, room_y) >= need)
            y = np.unique(y[ok])
            need = -(-num * (size[x] + size[y]) // (num + den))
            ok = np.minimum(spread[x], spread[y]).sum(1) >= need
            y, need = y[ok], need[ok]
            if not len(y):
                continue
            own = flat[start[x] : start[x + 1]]
            at = np.arange(size[y].sum()) + np.repeat(start[y] - np.cumsum(size[y]) + size[y], size[y])
            near = np.searchsorted(own, flat[at])
            same = own[np.minimum(near, len(own) - 1)] == flat[at]
            shared = np.bincount(np.repeat(np.arange(len(y)), size[y])[same], minlength=len(y))
            y = y[shared >= need]
            alive[y] = False
            root[y] = s
            stack += y.tolist()
        left = int(alive.sum())
        if left < held // 2:
            held = left
            docs_at, pos_at, edge = lists(alive)
    return root


def _sent(rows: DataFrame) -> DataFrame:
    """`rows`, to be broadcast if they are few enough; else joined by a shuffle."""
    return F.broadcast(rows) if rows.count() <= SENT_ROWS else rows


def _bodies(docs: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """(v, w, body) of the sets (v, w, id); one may come from several tasks."""
    rows, bits = _rows_of(docs, sets)

    def run(batches):
        for vw, g, bounds in _own_sets(batches, bits and bits.value, n):
            body = [g[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(vw[:, 0]), pa.array(vw[:, 1]), pa.array(body, pa.binary())], names=["v", "w", "body"])

    return rows.mapInArrow(lean(run), "v long, w long, body binary")


_SET = "struct<v: bigint, w: bigint>"


def _compared(dealt: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect what is linked inside each unit of `dealt`
    (unit, v, w, body); a set that comes twice is held once."""

    def run(batches):
        now, held = None, {}

        def links():
            vs = np.array(list(held), np.int64)
            root = linked_roots(list(held.values()), num, den)
            far = np.flatnonzero(root != np.arange(len(vs)))
            ends = [pa.StructArray.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["v", "w"]) for x in (vs[far], vs[root[far]])]
            return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

        for batch in batches:
            for unit, v, w, body in zip(*(batch.column(c).to_pylist() for c in ("unit", "v", "w")), batch.column("body")):
                if unit != now and held:
                    yield links()
                    held = {}
                now = unit
                held[v, w] = np.frombuffer(body.as_py(), _U64)
        if held:
            yield links()

    rows = dealt.select("unit", "v", "w", "body").repartition("unit").sortWithinPartitions("unit")
    return rows.mapInArrow(lean(run), f"a {_SET}, b {_SET}")


def _groups(postings: DataFrame) -> DataFrame:
    """(v, comp): sets that share a prefix key, by a chain."""
    hubs = stored(postings.groupBy("key").agg(F.min("v").alias("b")), "hubs")
    out = components(postings.join(hubs, "key").select(F.col("v").alias("a"), "b").distinct())
    discard(hubs)
    return out


def _open(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings of the keys that stand in sets of more than one component."""
    own = F.struct("v", "w")
    rows = postings.withColumn("node", own).join(labels, "node", "left").withColumn("root", F.coalesce("comp", "node")).drop("node", "comp")
    keys = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return rows.drop("root").join(keys, "key", "left_semi")


def _parts(total):
    """Units that sets of so many keys in all are dealt to."""
    return F.when(F.col(total) > GROUP_KEYS, F.ceil(F.col(total) / (GROUP_KEYS // 2))).otherwise(1).cast("int")


def once_each(postings: DataFrame, seed: int) -> DataFrame:
    """(v, w, unit) of every set, once: sets whose prefixes have the same
    smallest key, in the order of the seed, are in one unit or, where they are
    too many, in random units of bounded size."""
    rows = postings.groupBy("v", "w").agg(F.min(F.xxhash64("key", F.lit(seed))).alias("first"), F.max("size").alias("size"))
    total = rows.groupBy("first").agg(F.sum("size").alias("total")).select("first", _parts("total").alias("parts"))
    salt = F.pmod(F.xxhash64("v", "w", F.lit(seed)), F.col("parts"))
    return rows.join(total, "first").select("v", "w", F.xxhash64("first", salt).alias("unit"))


def by_key(postings: DataFrame) -> DataFrame:
    """(v, w, unit) such that any two sets that share a key share a unit.  Keys
    of few sets are put together; the sets of a key that are too many for one
    unit are dealt to parts, and every two parts meet."""
    total = postings.agg(F.sum("size")).first()[0] or 0
    keys = postings.groupBy("key").agg(F.sum("size").alias("total")).select("key", _parts("total").alias("parts"))
    own = F.pmod(F.xxhash64("v", "w"), F.col("parts")).cast("int")
    rows = postings.join(keys, "key").select("v", "w", "key", "parts", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    bucket = F.xxhash64(F.pmod(F.xxhash64("key"), F.lit(-(-int(total) // GROUP_KEYS) or 1)))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return rows.select("v", "w", F.when(F.col("parts") == 1, bucket).otherwise(pair).alias("unit")).distinct()


def _far_links(postings: DataFrame, bodies: DataFrame, num: int, den: int) -> DataFrame:
    """Step 4: links in groups of more than GROUP_KEYS keys.  `postings` are
    theirs."""
    links, left = None, stored(postings, "open")
    for seed in range(ROUNDS + 1):
        dealt = once_each(left, seed) if seed < ROUNDS else by_key(left)
        found = stored(_compared(dealt.join(bodies, ["v", "w"]), num, den), "links")
        links = found if links is None else links.unionByName(found)
        if seed == ROUNDS:
            break
        rest = stored(_open(left, components(links)), "open")
        discard(left)
        left = rest
        if left.isEmpty():
            break
        groups = _groups(left)
        sets = left.groupBy("v", "w").agg(F.max("size").alias("size")).join(groups.withColumnRenamed("node", "v"), "v")
        total = sets.groupBy("comp").agg(F.sum("size").alias("total"))
        sets = stored(sets.join(total, "comp"), "sets")
        small = sets.where(F.col("total") <= GROUP_KEYS)
        if not small.isEmpty():
            links = links.unionByName(stored(_compared(small.withColumn("unit", F.col("comp")).join(bodies, ["v", "w"]), num, den), "links"))
            rest = stored(left.join(sets.where(F.col("total") > GROUP_KEYS).select("v", "w"), ["v", "w"], "left_semi"), "open")
            discard(left)
            left = rest
            if left.isEmpty():
                break
    return links


def _links(docs: DataFrame, postings: DataFrame, keeper: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect what is linked inside each candidate group."""
    sets = stored(_groups(postings).withColumnRenamed("node", "v").join(keeper, "v"), "groups")
    total = stored(sets.groupBy("comp").agg(F.sum("size").alias("total")), "totals")
    sets = sets.join(total, "comp")
    small = stored(sets.where(F.col("total") <= GROUP_KEYS).select("v", "w", "id", F.col("comp").alias("unit")), "asked")
    large = total.where(F.col("total") > GROUP_KEYS).select("comp")
    near = _compared(_bodies(docs, small.select("id"), n).join(_sent(small.drop("id")), ["v", "w"]), num, den)
    near = stored(near, "links")
    if large.isEmpty():
        return near
    far = stored(sets.join(large, "comp", "left_semi").select("v", "w", "id"), "large")
    # One set may come from several tasks; its body is kept once.
    bodies = _bodies(docs, far.select("id"), n).join(far.drop("id"), ["v", "w"], "left_semi").groupBy("v", "w").agg(F.any_value("body").alias("body"))
    own = postings.join(far.drop("id"), "v")
    return near.unionByName(_far_links(own, stored(bodies, "bodies"), num, den))


def _judged(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(id, h, size, first) of every row of `docs` (id, h, text), `first` being
    the smallest (id, h) of the row's component; an empty set is its own."""
    profile = stored(_profile(docs, n), "profile")
    keeper = profile.where("size > 0").groupBy("v", "w").agg(F.min(F.struct("id", "h")).alias("least"), F.max("size").alias("size"))
    keeper = stored(keeper.select("v", "w", F.col("least.id").alias("id"), "least", "size"), "keeper")
    total = keeper.agg(F.sum("size")).first()[0] or 0
    postings = _postings(docs, keeper, n, num, den, max(1, round(total / BUCKET_KEYS)))
    labels = components(_links(docs, postings, keeper.drop("least"), n, num, den))
    # Sets with links are few; all others are their own component.
    linked = keeper.select("v", "w", "least", F.struct("v", "w").alias("node")).join(_sent(labels), "node")
    linked = stored(linked.select("v", "w", "comp", "least"), "linked")
    lowest = linked.groupBy("comp").agg(F.min("least").alias("first"))
    lowest = stored(linked.join(lowest, "comp").select("v", "w", "first"), "lowest")
    vertex = keeper.select("v", "w", "least").join(_sent(lowest), ["v", "w"], "left").select("v", "w", F.coalesce("first", "least").alias("first"))
    discard(postings)
    own = F.struct("id", "h")
    return profile.join(vertex, ["v", "w"], "left").select("id", "h", "size", F.when(F.col("size") > 0, F.coalesce("first", own)).otherwise(own).alias("first"))


def identified(docs: DataFrame) -> DataFrame:
    """(id, h, text) of rows: doc_id with a number for null, and the text's hash."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def near_duplicate_groups(docs: DataFrame, n: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    out = _judged(identified(docs), n, num, den)
    return out.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), F.col("size").alias("n_shingles"), F.nullif(F.col("first.id"), F.lit(NO_ID)).alias("component_id"))


def near_duplicate_rows(docs: DataFrame, n: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """(id, h, first, size) of every row as `identified` names it: of the rows
    with one `first`, that whose own (id, h) it is stays."""
    return _judged(identified(docs), n, num, den)
