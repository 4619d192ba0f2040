"""Chat formatting as a prefix tree.

Template: a turn is `<s>role\\ntext\\n</s>`.  Control strings inside a text get
one more backslash before them, and lose it again when read, so they are never
taken for the template's own.  Conversations that share their first turns share
tree nodes: a node is a turn with all turns before it.  Nodes are laid out depth
first in one stream of token ids; a node carries the stream offset of its ids,
the position of its first id in a conversation, the ids under the loss mask, and
the stream intervals of itself and its ancestors, which are all that its tokens
attend to.

Order of the stream: a node's key has a hash for each level at which its path
parts from other conversations, so keys stay short for long unshared
conversations, a parent's key begins its children's, and sorting by (key, depth)
is depth first.  Conversations are streamed in turn order; no conversation, node
or tree is gathered.

What moves: texts once, to their conversation, where they are encoded; ids once
to their node's row and once into stream order; and ids once when read back.  Ids
of a vocabulary of at most 2^16 move as 16-bit integers, and are written as 32-bit
ones.  All else is a few numbers for each turn.  Nodes of one conversation alone need no
join to find their conversation; nodes that several share are joined on (node,
salt), and those that very many share (HOT, of which there are few) by a
broadcast, so no node is a task of its own.

Defined cases: null text and role count as empty; rows of a conversation are
ordered by turn (null first), then role and text, repeated rows being turns of
their own; rows without conv_id are one conversation; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, lean, scratch, stored, text_view
from .encode import encoder

#: The control strings.
CONTROL = re.compile(r"</?s>|\[/?INST\]|<</?SYS>>")
_ESCAPE = re.compile(rf"(\\*(?:{CONTROL.pattern}))")
_UNESCAPE = re.compile(rf"\\(\\*(?:{CONTROL.pattern}))")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def role_mark(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def read_role(mark: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], mark)


def parts(role: str, text: str) -> tuple[str, str, str]:
    """Head, body and tail of a turn; the body alone can be under the mask."""
    return f"<s>{role_mark(role)}\n", escape(text), "\n</s>"


def parse_turn(formatted: str) -> tuple[str, str]:
    head, _, rest = formatted.partition("\n")
    if not head.startswith("<s>") or not rest.endswith("\n</s>"):
        raise ValueError("not a turn")
    return read_role(head[3:]), unescape(rest[:-5])


# ---------------------------------------------------------------- streaming

#: Stands for a null conv_id inside.
NO_ID = -(1 << 63)
#: Conversations that share a node which is called hot, at least; where that
#: would make more than HOT_NODES, fewer are.
HOT, HOT_NODES = 10_000, 500_000
_ROWS = 2000


#: 16-bit ids are signed in Spark, so they move less this.
_SHIFT = 1 << 15


def _narrow(tokenizer: str) -> bool:
    """Whether all ids of the vocabulary fit 16 bits."""
    return max(encoder(tokenizer, special_text=True).tokenizer.get_vocab().values()) < 1 << 16


def _by_conversation(rows: DataFrame, fn, schema: str, order: list[str]) -> DataFrame:
    """fn over the rows of each partition, whole conversations in order."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(lean(fn), schema)


def encoded_turns(conversations: DataFrame, tokenizer: str, loss_role: str) -> DataFrame:
    """conv_id, k, node, parent, n_tokens, loss_from, loss_to and ids of every
    turn; ids are empty where the task had the node before, and less _SHIFT where
they are 16-bit ones.  Head, body and tail
    are encoded apart, so the mask begins and ends between ids."""
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv_id"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    narrow = _narrow(tokenizer)

    def run(batches):
        enc, seen = encoder(tokenizer, special_text=True), set()
        now, k, node = object(), 0, b""
        for whole in batches:
            for first in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(first, _ROWS)
                convs, roles, texts = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
                ks, nodes, parents, fresh = [], [], [], []
                for conv, role, text in zip(convs, roles, texts):
                    if conv != now:
                        now, k, node = conv, 0, b""
                    parents.append(node or None)
                    head = role.encode()
                    node = hashlib.blake2b(node + len(head).to_bytes(4, "little") + head + text.encode(), digest_size=16).digest()
                    fresh.append(node not in seen)
                    seen.add(node)
                    ks.append(k)
                    nodes.append(node)
                    k += 1
                bounds, ids = enc.encode(*text_view(pa.array([p for r, t in zip(roles, texts) for p in parts(r, t)], pa.large_string())))
                at, new = bounds[0::3], np.array(fresh, bool)
                size = np.diff(at)
                loss = np.array([r == loss_role for r in roles], bool)
                kept = np.concatenate([[0], np.cumsum(np.where(new, size, 0))]).astype(np.int32)
                moved = ids[np.repeat(new, size)]
                if narrow:
                    moved = (moved - _SHIFT).astype(np.int16)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("conv_id"),
                        pa.array(ks, pa.int32()),
                        pa.array(nodes, pa.binary()),
                        pa.array(parents, pa.binary()),
                        pa.array(size),
                        pa.array(np.where(loss, bounds[1::3] - at[:-1], 0)),
                        pa.array(np.where(loss, bounds[2::3] - at[:-1], 0)),
                        pa.ListArray.from_arrays(pa.array(kept), pa.array(moved)),
                    ],
                    names=["conv_id", "k", "node", "parent", "n_tokens", "loss_from", "loss_to", "ids"],
                )

    schema = f"conv_id long, k int, node binary, parent binary, n_tokens long, loss_from long, loss_to long, ids array<{'smallint' if narrow else 'int'}>"
    return _by_conversation(rows, run, schema, ["turn", "role", "text"])


def _marked(turns: DataFrame, shared: DataFrame, hot: int) -> DataFrame:
    """Turns with the owner (the smallest conv_id that has the node) and the
    number of conversations of their node."""
    few = F.broadcast(shared.where(F.col("n_convs") >= hot))
    rest = shared.where(F.col("n_convs") < hot)
    rows = turns.join(few, "node").unionByName(turns.join(few, "node", "left_anti").join(rest, "node", "left"), allowMissingColumns=True)
    return rows.withColumn("owner", F.coalesce("owner", "conv_id")).withColumn("n_convs", F.coalesce("n_convs", F.lit(1)))


def _to_conversations(paths: DataFrame, nodes: DataFrame, hot: int) -> DataFrame:
    """Each shared node's row for each conversation that has it.  `paths` has
    conv_id, k, node and n_convs, `nodes` node and n_convs among others."""
    salts = F.ceil(F.col("n_convs") / hot)
    many = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("n_convs")
    return paths.withColumn("salt", F.pmod(F.xxhash64("conv_id"), salts)).join(many, ["node", "salt"]).drop("salt")


def _keys(rows: DataFrame) -> DataFrame:
    """Order key and first position of each node, from its owner's path."""
    names = ["conv_id", "k", "node", "n_tokens", "n_convs"]

    def run(batches):
        now = object()
        for batch in batches:
            own, keys, positions = [], [], []
            for i, (conv, node, owner, convs, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "node", "owner", "n_convs", "n_tokens")))):
                if conv != now:
                    now, key, pos, last = conv, b"", 0, None
                if convs != last:
                    key, last = key + node[:8], convs
                if owner == conv:
                    own.append(i)
                    keys.append(key)
                    positions.append(pos)
                pos += n
            kept = batch.take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in names), pa.array(keys, pa.binary()), pa.array(positions, pa.int64())], names=[*names, "key", "position"])

    return _by_conversation(rows, run, "conv_id long, k int, node binary, n_tokens long, n_convs long, key binary, position long", ["k"])


def _laid_out(nodes: DataFrame) -> DataFrame:
    """Nodes (without their ids) with `start`, their offset in the stream."""
    fields = [c for c in nodes.columns if c != "key"]

    def run(batches):
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            run_up = np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in fields), pa.array(np.full(len(n), part, np.int32)), pa.array(start + run_up[:-1])], names=[*fields, "part", "part_start"]
            )
            start += int(run_up[-1])

    types = {f.name: f.dataType.simpleString() for f in nodes.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in fields) + ", part int, part_start long"
    rows = stored(nodes.repartitionByRange("key", "k").sortWithinPartitions("key", "k").mapInArrow(lean(run), schema), "layout")
    # One row for each partition, so the window over all of them is small.
    base = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = base.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("part_start")).drop("base", "part", "part_start")


def _intervals(rows: DataFrame) -> DataFrame:
    """Stream intervals of each node and its ancestors, neighbours merged."""

    def run(batches):
        now = object()
        for batch in batches:
            out = [[], [], []]
            for conv, node, owner, start, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "node", "owner", "start", "n_tokens"))):
                if conv != now:
                    now, lo, hi, root = conv, [], [], node
                if hi and hi[-1] == start:
                    hi[-1] = start + n
                else:
                    lo.append(start)
                    hi.append(start + n)
                if owner == conv:
                    out[0].append(node)
                    out[1].append(root)
                    out[2].append([{"lo": a, "hi": b} for a, b in zip(lo, hi)])
            kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.binary(), kind))], names=["node", "tree", "attend"])

    return _by_conversation(rows, run, "node binary, tree binary, attend array<struct<lo: bigint, hi: bigint>>", ["k"])


def write_chat_tree(conversations: DataFrame, path: str, tokenizer: str, loss_role: str = "assistant") -> None:
    """Write `path`/nodes (in stream order by `start`) and `path`/paths, the
    nodes of each conversation."""
    turns = stored(encoded_turns(conversations, tokenizer, loss_role), "turns")
    steps = turns.select("conv_id", "k", "node", "n_tokens")
    hot = max(HOT, turns.count() // HOT_NODES)
    shared = turns.groupBy("node").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 1")
    shared = stored(shared, "shared")
    layout = _laid_out(_keys(_marked(steps, shared, hot)))
    # Stream offsets go back to each conversation that has the node.
    several = _marked(steps.join(shared.select("node"), "node", "left_semi"), shared, hot) if not shared.isEmpty() else None
    alone = layout.where("n_convs = 1").select("conv_id", "k", "node", F.col("conv_id").alias("owner"), "start", "n_tokens")
    if several is not None:
        found = _to_conversations(several.drop("n_tokens"), layout.where("n_convs > 1").select("node", "n_convs", "start", "n_tokens"), hot)
        alone = alone.unionByName(found.select(*alone.columns))
    spans = _intervals(alone)
    rows = layout.join(spans, "node").withColumnRenamed("k", "depth")
    out = rows.join(turns.where(F.size("ids") > 0).drop("k", "n_tokens"), ["node", "conv_id"])
    out = out.select("tree", "node", "parent", "depth", "start", "position", "n_tokens", "ids", "loss_from", "loss_to", "attend", F.col("conv_id").alias("owner"), "n_convs")
    out = out.repartitionByRange("start").sortWithinPartitions("start")
    if _narrow(tokenizer):
        out = out.withColumn("ids", F.transform("ids", lambda x: x.cast("int") + _SHIFT))
    out.write.option("compression", "zstd").parquet(f"{path}/nodes")
    paths = steps.select("conv_id", "k", "node").join(shared.select("node", "n_convs"), "node", "left")
    paths.select(F.nullif("conv_id", F.lit(NO_ID)).alias("conv_id"), "k", "node", F.coalesce("n_convs", F.lit(1)).alias("n_convs")).write.parquet(f"{path}/paths")
    discard(turns, shared)


def read_turns(spark, path: str) -> DataFrame:
    """(conv_id, k, ids, loss_from, loss_to) of every turn; null conv_id: NO_ID."""
    nodes = spark.read.parquet(f"{path}/nodes").select("node", "owner", "depth", "n_convs", "ids", "loss_from", "loss_to")
    alone = nodes.where("n_convs = 1").select(F.col("owner").alias("conv_id"), F.col("depth").alias("k"), "ids", "loss_from", "loss_to")
    paths = spark.read.parquet(f"{path}/paths").where("n_convs > 1").withColumn("conv_id", F.coalesce("conv_id", F.lit(NO_ID)))
    several = _to_conversations(paths, nodes.where("n_convs > 1").drop("owner", "depth"), HOT)
    return alone.unionByName(several.select(*alone.columns))


def chat_digest(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and
    formatted_chars of each conversation, read back from the written tree."""
    spark = conversations.sparkSession
    path = scratch(spark, "chat-tree")
    write_chat_tree(conversations, path, tokenizer)
    turns, narrow = read_turns(spark, path), _narrow(tokenizer)
    if narrow:
        turns = turns.withColumn("ids", F.transform("ids", lambda x: (x - _SHIFT).cast("smallint")))

    def run(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        tok = encoder(tokenizer, special_text=True).tokenizer
        now, state, done = object(), None, []

        def close():
            if state is not None:
                done.append((None if now == NO_ID else now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done), types)], names=names)

        for whole in batches:
            for first in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(first, _ROWS)
                convs, lo, hi = (batch.column(c).to_pylist() for c in ("conv_id", "loss_from", "loss_to"))
                lists = batch.column("ids")
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32) + (_SHIFT if narrow else 0)
                at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                ids = [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
                formatted = tok.decode_batch(ids, skip_special_tokens=False)
                masked = [i for i in range(len(ids)) if lo[i] < hi[i]]
                loss = dict(zip(masked, tok.decode_batch([ids[i][lo[i] : hi[i]] for i in masked], skip_special_tokens=False)))
                for i, conv in enumerate(convs):
                    if conv != now:
                        close()
                        now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    role, text = parse_turn(formatted[i])
                    said = unescape(loss.get(i, ""))
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    state[2] += len(said)
                    state[3].update(said.encode())
                    state[4] += len(formatted[i])
                if done:
                    yield rows()
                    done = []
        close()
        if done:
            yield rows()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return _by_conversation(turns, run, schema, ["k"])
