"""Fast exact use of a public tokenizer on whole Arrow text columns.

The pre-tokenizers of both vocabularies used here never join text across
certain places, so a text may be cut there and its parts encoded alone.  Equal
parts are encoded once and looked up afterwards.  Places, with "solid" for a
byte that cannot belong to white space:

* before a space that a solid byte follows;
* before and after a newline between two solid bytes;
* before one of .,;:!? between a letter and such a place (or the text's end).

A text that holds a special token's string is encoded whole, by the tokenizer's
own call: white space beside such a token is cut in other ways.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from .common import ASCII_SPACE, BLOCK_BYTES, blocks, byte_class, text_view

#: Lead bytes of the non-ASCII white space characters.
_DOUBT = np.zeros(256, bool)
_DOUBT[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = byte_class(bytes([*range(65, 91), *range(97, 123)]))
_STOP = byte_class(b".,;:!?")


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted starts of the parts; each document's start is one if it has bytes."""
    n = len(data)
    cut = np.zeros(n, bool)
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    if n > 1:
        head = ~(ASCII_SPACE | _DOUBT)[data]  # a following byte that is solid
        head &= (data < 0x80) | (data >= 0xC0)
        space = np.flatnonzero((data[:-1] == 32) & head[1:])
        cut[space] = True
        line = np.flatnonzero((data[1:-1] == 10) & head[2:]) + 1
        if len(line):
            back = [data[np.maximum(line - k, 0)] for k in (1, 2, 3)]
            solid = np.where(back[0] < 0x80, ~ASCII_SPACE[back[0]], ~(_DOUBT[back[1]] | _DOUBT[back[2]]))
            line = line[solid]
            cut[line] = True
            cut[line + 1] = True
        ends = np.append(cut[1:], True)
        ends[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
        stop = np.flatnonzero(ends[2:] & _STOP[data[2:]]) + 2
        if len(stop):
            a, b = data[stop - 1], data[stop - 2]
            letter = _LETTER[a] | ((b == 0xC3) & (a >= 0x80) & (a != 0x97) & (a != 0xB7))  # of Latin-1 too, but for its signs
            stop = stop[letter & ~cut[stop]]
            cut[stop] = True
    return np.flatnonzero(cut)


class Encoder:
    """Token ids of whole texts, as `encode(text, add_special_tokens=False)`
    gives them: a special token's string in a text becomes its id.  With
    `special_text` such strings are ordinary text.

    The cache of parts is bounded by `max_parts`: when it is full, the half of
    them that was met in the fewest blocks goes.
    """

    #: A part of its own between others that are encoded in one call.
    BETWEEN = b" \x00"

    def __init__(self, tokenizer_path: str, max_parts: int = 400_000, special_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = special_text
        names = [] if special_text else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, names))) if names else None
        self.between = self.tokenizer.encode(self.BETWEEN.decode(), add_special_tokens=False).ids
        self.max_parts = max_parts
        self._keep(np.zeros(0, np.int64), [])

    def _keep(self, which: np.ndarray, parts: list[bytes]) -> None:
        """Go on with these entries of the cache only."""
        counts = self.counts[which] if len(which) else np.zeros(0, np.int64)
        run = np.concatenate([[0], np.cumsum(counts)])
        ids = np.zeros(max(1 << 20, 2 * int(run[-1])), np.int32)
        if len(which):
            ids[: run[-1]] = self.ids[np.arange(run[-1]) + np.repeat(self.starts[which] - run[:-1], counts)]
        self.known: dict[bytes, int] = dict(zip(parts, range(len(parts))))
        room = self.max_parts * 2
        self.ids, self.used = ids, int(run[-1])
        self.starts, self.counts, self.met = (np.zeros(room, np.int64) for _ in range(3))
        self.starts[: len(which)], self.counts[: len(which)] = run[:-1], counts

    def _shrink(self) -> None:
        parts = list(self.known)
        met = self.met[: len(parts)]
        least = 1
        while (met > least).sum() > self.max_parts // 2:
            least += 1
        which = np.flatnonzero(met > least)
        aged = met[which] // 2
        self._keep(which, [parts[i] for i in which])
        self.met[: len(which)] = aged

    def _ids(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each part, end to end, and their counts."""
        got = self.tokenizer.encode_batch_fast([p.decode("utf-8") for p in parts], add_special_tokens=False)
        flat = [np.array(e.ids, np.int32) for e in got]
        return (np.concatenate(flat) if flat else np.zeros(0, np.int32)), np.fromiter(map(len, flat), np.int64, len(flat))

    def _learn(self, parts: list[bytes]) -> None:
        joined = [p for p in parts if p[0] == 32 and 0 not in p]
        alone = [p for p in parts if p[0] != 32 or 0 in p]
        flat, counts = self._ids(alone)
        if joined:
            texts = [self.BETWEEN.join(joined[i : i + 256]) + self.BETWEEN for i in range(0, len(joined), 256)]
            ids, _ = self._ids(texts)
            stop = np.flatnonzero(ids == self.between[-1]) + 1
            size = np.diff(np.concatenate([[0], stop])) - len(self.between)
            own = np.ones(len(ids), bool)
            for k in range(len(self.between)):
                own[stop - 1 - k] = False
            flat, counts = np.concatenate([flat, ids[own]]), np.concatenate([counts, size])
        k, n = len(self.known), len(parts)
        while k + n > len(self.starts):
            self.starts, self.counts, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts, self.met))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[k : k + n] = self.used + np.cumsum(counts) - counts
        self.counts[k : k + n] = counts
        self.used += len(flat)
        self.known.update(zip(alone + joined, range(k, k + n)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bounds by document, ids)."""
        held = [m.start() for m in self.special.finditer(memoryview(np.ascontiguousarray(data)))] if self.special else []
        if not held:
            return self._encode_parts(data, offsets)
        whole = np.unique(np.searchsorted(offsets, held, side="right") - 1)
        other = np.ones(len(offsets) - 1, bool)
        other[whole] = False
        size = np.diff(offsets)
        bounds, ids = self._encode_parts(data[np.repeat(other, size)], np.concatenate([[0], np.cumsum(size[other])]))
        counts = np.zeros(len(size), np.int64)
        counts[other] = np.diff(bounds)
        alone = [np.array(self.tokenizer.encode(data[offsets[d] : offsets[d + 1]].tobytes().decode(), add_special_tokens=False).ids, np.int32) for d in whole]
        counts[whole] = [len(x) for x in alone]
        run = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(run[-1], np.int32)
        out[np.repeat(other, counts)] = ids
        out[np.repeat(~other, counts)] = np.concatenate(alone)
        return run, out

    def _encode_parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = cuts(data, offsets)
        if not len(starts):
            return np.zeros(len(offsets), np.int64), np.zeros(0, np.int32)
        edges = np.append(starts, len(data)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
        coded = parts.dictionary_encode()
        unique = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist()
        if len(self.known) > self.max_parts:
            self._shrink()
        known = self.known
        if missing := [p for p in unique if p not in known]:
            self._learn(missing)
        own = np.fromiter(map(self.known.__getitem__, unique), np.int64, len(unique))
        self.met[own] += 1
        at = coded.indices.to_numpy()
        counts = self.counts[own][at]
        run = np.concatenate([[0], np.cumsum(counts)])
        # The ids of this block's parts end to end, then one copy of them for each place.
        sizes = self.counts[own]
        first = np.cumsum(sizes) - sizes
        ids = self.ids[np.arange(sizes.sum()) + np.repeat(self.starts[own] - first, sizes)]
        take = np.arange(run[-1]) + np.repeat(first[at] - run[:-1], counts)
        return run[np.searchsorted(starts, offsets)], ids[take]


def encoded_blocks(encoder: Encoder, col: pa.Array, end_id: int):
    """(first row, end row, bounds, ids) by block; each text's ids, then end_id."""
    data, offsets = text_view(col)
    for i, j in blocks(offsets, 4 * BLOCK_BYTES):
        lo, hi = offsets[i], offsets[j]
        bounds, ids = encoder.encode(data[lo:hi], offsets[i : j + 1] - lo)
        n = j - i
        out_bounds = bounds + np.arange(n + 1)
        out = np.full(len(ids) + n, end_id, np.int32)
        keep = np.ones(len(out), bool)
        keep[out_bounds[1:] - 1] = False
        out[keep] = ids
        yield i, j, out_bounds, out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_text: bool = False) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if (path, special_text) not in _ENCODERS:
        _ENCODERS[path, special_text] = Encoder(path, special_text=special_text)
    return _ENCODERS[path, special_text]
