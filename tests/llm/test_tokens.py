"""Token output, chat trees and packing, against direct use of the tokenizers."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from formloom.llm import op01_token_orc as orc
from formloom.llm import op04_chat_tree as chat
from formloom.llm import op07_packing as packing
from formloom.llm.common import scratch
from formloom.llm.encode import Encoder, encoded_blocks

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def plain(path):
    return Tokenizer.from_file(path)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_parts_encode_like_whole_texts(path):
    random.seed(7)
    letters = list(" \n\t\r\u00a0\u3000\u2003abcdeé'sß\u0301\u0085漢123.,!Σ\x1c\x0bİ🙂\u200b\x00") + [" ", "  ", "'s", " a", "\n\n", "<|endoftext|>", "<|startoftext|>"]
    texts = ["".join(random.choices(letters, k=random.randint(0, 40))) for _ in range(4000)] + [None, ""]
    t, small = plain(path), Encoder(path, max_parts=500)
    want = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    for enc in (Encoder(path), small):
        got = [ids[bounds[k] : bounds[k + 1]].tolist() for _, _, bounds, ids in itertools.chain(encoded_blocks(enc, pa.array(texts[:2000]), 7), encoded_blocks(enc, pa.array(texts[2000:]), 7)) for k in range(len(bounds) - 1)]
        assert got == [w + [7] for w in want]
    # Where such strings are to be text, no special id appears.
    enc, special = Encoder(path, special_text=True), set(t.get_added_tokens_decoder())
    assert special and any(special & set(w) for w in want)
    t.encode_special_tokens = True
    got = [ids[bounds[k] : bounds[k + 1]].tolist() for _, _, bounds, ids in encoded_blocks(enc, pa.array(texts), 7) for k in range(len(bounds) - 1)]
    assert got == [e.ids + [7] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_special_strings():
    enc = Encoder(BYTE)
    assert next(encoded_blocks(enc, pa.array(["a<|endoftext|>b"]), 2))[3].tolist() == [64, 50256, 65, 2]


def expected_orc(rows, end):
    t, start, out = plain(BYTE), 0, []
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_op1(run, documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    got = run("op1_token_orc").sort_values("start")
    assert list(got[["doc_id", "start", "n_tokens", "ids_crc32"]].itertuples(index=False, name=None)) == expected_orc(rows, 2)


def test_op1_edges(spark, edge, empty):
    rows = sorted(((r.doc_id, r.text) for r in edge.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in orc.token_orc_digest(edge, BYTE, 9).orderBy("start").collect()]
    assert got == expected_orc(rows, 9)
    assert orc.token_orc_digest(empty, BYTE).count() == 0


def test_op1_lookup(spark, documents):
    path = scratch(spark, "test-orc")
    orc.write_token_orc(documents, path, BYTE, 2)
    rows = orc.lookup(spark, path, [3, 77])
    assert {r.doc_id: len(r.ids) for r in rows.collect()} == {r.doc_id: r.n_tokens for r in rows.collect()} and rows.count() == 2
    assert "PushedFilters: [In(doc_id, [3,77])]" in rows._jdf.queryExecution().toString()
    text = documents.where("doc_id = 3").first().text
    assert plain(BYTE).decode(rows.where("doc_id = 3").first().ids[:-1]) == text


def test_op1_reads_few_rows_for_an_id(spark):
    """Statistics and Bloom filters keep most rows from being read."""
    path = scratch(spark, "test-prune")
    docs = spark.range(20_000).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    orc.write_token_orc(docs.coalesce(1), path, BYTE, 2)

    def read(ids):
        rows = orc.lookup(spark, path, ids)
        leaf = rows._jdf.queryExecution().executedPlan().collectLeaves().head()
        out = rows._jdf.queryExecution().executedPlan().executeCollect()
        return len(out), leaf.metrics().apply("numOutputRows").value()

    found, read_rows = read([10_000])
    assert found == 1 and read_rows <= 1000
    assert read([10_001]) == (0, 0)  # between two ids: the Bloom filter
    assert read([90_000]) == (0, 0)


def check_packing(got, rows, t, capacity=2048):
    want = {}
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            piece = ids[k : k + capacity]
            want.setdefault((d, k // capacity, k, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())), []).append(1)
    have = {}
    for r in got:
        have.setdefault((r.doc_id, r.piece, r.start, r.length, r.ids_crc32), []).append(1)
    assert have == want
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values(), default=0) <= capacity
    return len(ends), -(-sum(ends.values()) // capacity)


def test_op7(run, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    used, floor = check_packing(list(run("op7_packing").itertuples()), rows, plain(WORD))
    assert used <= floor + 1


def test_op7_edges(edge, empty):
    got = packing.pack_documents(edge, WORD).collect()
    check_packing(got, [(r.doc_id, r.text) for r in edge.collect()], plain(WORD))
    assert packing.pack_documents(empty, WORD).count() == 0


def test_op7_many_shards(spark):
    rng = np.random.default_rng(3)
    lengths = [int(x) for x in np.clip(rng.lognormal(6, 0.9, 6000), 1, 2047)]
    pieces = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long")
    got = packing.pack(pieces, shard=1000).toPandas().merge(pieces.toPandas(), on="uid")
    fill = got.groupby("sequence_id").length.sum()
    assert len(got) == 6000 and fill.max() <= 2048
    assert len(fill) <= 1.003 * sum(lengths) / 2048 + 2
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(5)
    size = rng.integers(1, 2048, 300).tolist()
    a = packing.packed(list(range(300)), size, 2048)
    b = packing.packed(sorted(range(300), key=lambda i: -size[i]), size, 2048)
    c = packing.crossover(a, b, size, 2048, rng)
    assert sorted(i for held in c.bins for i in held) == list(range(300))
    assert all(sum(size[i] for i in held) + room == 2048 for held, room in zip(c.bins, c.free))
    best = packing.evolve(size, [], 2048, 20, 4, rng)[0]
    assert len(best.bins) <= len(b.bins)


def expected_chat(rows):
    out = {}
    for conv, group in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")), key=lambda r: r[0]):
        group = [(r or "", t or "") for _, _, r, t in group]
        loss = "".join(t for r, t in group if r == "assistant")
        turns = "".join(f"{r}\n{t}\n" for r, t in group)
        out[conv] = (len(group), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len("".join(chat.parts(r, t))) for r, t in group))
    return out


def read_chat(df):
    return {r.conv_id: tuple(r)[1:] for r in df.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()}


def test_op4(spark, run):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    got = {r.conv_id: tuple(r)[2:] for r in run("op4_chat_tree")[["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]].itertuples()}
    assert got == expected_chat(rows + [(-1, 0, "user", said), (-1, 1, "assistant", said)])


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "x"), (2, 0, "user", "hi"), (2, 1, "assistant", "x"), (2, 2, "user", "more"), (3, 0, "user", "hi"), (3, 1, "assistant", "y \\</s>\\"), (4, 0, "user", "hi"), (4, 1, "assistant", "x"),
    (5, 0, None, None), (5, None, "user", "\\\\[INST]<s>\n</s>\n\\"), (6, 0, "assistant", ""), (6, 0, "assistant", ""), (None, 0, "user", "no id"), (None, 1, "we\nird\\role", "🙂"), (7, 0, "user", "a <<SYS>> b <</SYS>>"),
] + [(8, i, "assistant", f"t{i}") for i in range(300)] + [(9, i, "assistant", f"t{i}") for i in range(300)]


def test_op4_nodes_that_many_share(spark, monkeypatch):
    """Hot nodes by a broadcast, shared ones by salted joins."""
    rows = [(i, k, "user" if k % 2 == 0 else "assistant", "hello" if k == 0 else f"t{i % 7 if k == 1 else i}-{k}") for i in range(120) for k in range(1 + i % 4)]
    df = spark.createDataFrame(rows + CHATS, "conv_id long, turn long, role string, text string").repartition(5)
    want = expected_chat(rows + CHATS)
    assert read_chat(chat.chat_digest(df, BYTE)) == want
    monkeypatch.setattr(chat, "HOT", 10)
    assert read_chat(chat.chat_digest(df, BYTE)) == want


def test_op4_edges_and_tree(spark):
    df = spark.createDataFrame([(*r, "z") for r in CHATS], "conv_id long, turn long, role string, text string, node string")
    assert read_chat(chat.chat_digest(df, BYTE)) == expected_chat(CHATS)
    assert chat.chat_digest(df.limit(0), BYTE).count() == 0
    path = scratch(spark, "test-chat")
    chat.write_chat_tree(df, path, BYTE)
    nodes = spark.read.parquet(f"{path}/nodes").orderBy("start").collect()
    paths = {}
    for r in spark.read.parquet(f"{path}/paths").orderBy("conv_id", "k").collect():
        paths.setdefault(r.conv_id, []).append(bytes(r.node))
    assert len(nodes) == len({n for p in paths.values() for n in p}) and paths[1] == paths[4] == paths[2][:2]
    by = {bytes(n.node): n for n in nodes}
    at, stack = 0, []
    for n in nodes:  # depth first: a node's parent is on the path to the node before it
        assert n.start == at
        at += n.n_tokens
        while stack and (n.parent is None or stack[-1] != bytes(n.parent)):
            stack.pop()
        assert (n.parent is None) == (not stack)
        stack.append(bytes(n.node))
    for p in paths.values():
        spans, position = [], 0
        for key in p:
            n = by[key]
            assert n.position == position
            position += n.n_tokens
            spans += range(n.start, n.start + n.n_tokens)
            assert sorted(i for a in n.attend for i in range(a.lo, a.hi)) == sorted(spans)
    assert len(by[paths[8][-1]].attend) == 1
    end = by[paths[3][1]]
    assert chat.unescape(Tokenizer.from_file(BYTE).decode(end.ids[end.loss_from : end.loss_to], skip_special_tokens=False)) == "y \\</s>\\"


def test_escape_round_trip():
    random.seed(2)
    bits = ["\\", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\n", "a", " "]
    for _ in range(3000):
        text = "".join(random.choices(bits, k=random.randint(0, 12)))
        for role in ("user", "a\nb\\n"):
            assert chat.parse_turn("".join(chat.parts(role, text))) == (role, text)
