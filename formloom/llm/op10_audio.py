"""Media columns: WAV bytes, spectra and spectral-peak pair fingerprints.

`to_media` stores payloads as 8-bit mono WAV in a binary column; `media_prints`
reads such a column with the wave module, takes a short-time Fourier transform
and pairs spectral peaks.  A print is one integer: frame << 32 | low bin << 20 |
high bin << 8 | frames between, so prints sort by time.  Both work row by row in
Arrow batches without a shuffle.  `audio_digest` writes the media column to the
shared folder and takes everything from what it reads back.

Defined cases: null text counts as empty, whose payload is one unit of padding;
silent or constant frames have no peaks; null or unreadable media gives nulls
and no prints; repeated rows give equal values; other columns of the media
table are kept.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stored

UNIT = 576
RATE = 8000
PAD = b"\xff"
#: Samples of a frame, and between the starts of two frames.
FRAME, HOP = 192, 96
#: Peaks of a frame, frames ahead and partners for each peak.
PEAKS, AHEAD, PARTNERS = 2, 3, 2
#: Frames that are transformed at once.
FRAMES_AT_ONCE = 2048

_WINDOW = np.hanning(FRAME)


def wav_bytes(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def wav_samples(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def spectral_peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the strongest local maxima of each frame, by frame."""
    x = np.frombuffer(samples, np.uint8).astype(float) - 128
    if len(x) < FRAME:
        x = np.pad(x, (0, FRAME - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    at, bins = [], []
    for lo in range(0, len(frames), FRAMES_AT_ONCE):
        part = frames[lo : lo + FRAMES_AT_ONCE]
        part = part - part.mean(1, keepdims=True)
        power = np.abs(np.fft.rfft(part * _WINDOW)) ** 2
        # Whole numbers, so that ties and rounding are settled the same way.
        power = np.rint(power)
        inner = power[:, 1:-1]
        best = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0)
        top = np.argpartition(-best, PEAKS, axis=1)[:, :PEAKS]
        r, c = np.nonzero(np.take_along_axis(best, top, 1) > 0)
        b = top[r, c] + 1
        o = np.lexsort((b, r))
        at.append(r[o] + lo)
        bins.append(b[o])
    return np.concatenate(at), np.concatenate(bins)


def peak_pairs(at: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Time-coded prints: each peak with the next PARTNERS peaks of the frames
    up to AHEAD after its own."""
    found = []
    after = np.searchsorted(at, at, side="right")
    for k in range(PARTNERS):
        j = after + k
        i = np.flatnonzero(j < len(at))
        j = j[i]
        gap = at[j] - at[i]
        ok = gap <= AHEAD
        i, j, gap = i[ok], j[ok], gap[ok]
        found.append((at[i].astype(np.int64) << 32) | (bins[i].astype(np.int64) << 20) | (bins[j].astype(np.int64) << 8) | gap)
    prints = np.concatenate(found)
    prints.sort()
    return prints


def to_media(docs: DataFrame, keep: list[str], text: str = "text", unit: int = UNIT) -> DataFrame:
    """`keep`, n_bytes and media: the text's UTF-8 bytes, padded, as WAV."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", n_bytes long, media binary"

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                sizes, media = [], []
                for t in batch.column(text):
                    raw = (t.as_py() or "").encode()
                    sizes.append(len(raw))
                    media.append(wav_bytes(raw + PAD * (-len(raw) % unit or (0 if raw else unit))))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[*keep, "n_bytes", "media"])

    return docs.select(*keep, text).mapInArrow(lean(run), schema)


_PRINTS = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("prints", pa.list_(pa.int64()))]


def media_prints(media: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` and what the stored bytes hold: payload and media digests, and
    prints array<long>."""
    types = {f.name: f.dataType.simpleString() for f in media.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, prints array<long>"

    def one(raw):
        if raw is None:
            return (None,) * 5 + ([],)
        try:
            samples = wav_samples(raw)
        except (wave.Error, EOFError):
            return None, None, None, len(raw), hashlib.sha256(raw).hexdigest(), []
        prints = peak_pairs(*spectral_peaks(samples))
        return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), prints

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                rows = [one(m.as_py()) for m in batch.column("media")]
                cols = [pa.array(list(c), t) for c, (_, t) in zip(zip(*rows), _PRINTS)] if rows else [pa.nulls(0, t) for _, t in _PRINTS]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *cols], names=[*keep, *(n for n, _ in _PRINTS)])

    return media.select(*dict.fromkeys([*keep, "media"])).mapInArrow(lean(run), schema)


def audio_digest(docs: DataFrame, pairs: int = 16) -> DataFrame:
    """One row for each document: digests of the stored form, its prints
    (time-coded, in order), and a feature of their number and the `pairs`
    smallest hashes of peak pairs, time left out."""
    media = to_media(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), ["doc_id"])
    rows = media_prints(stored(media, "media"), ["doc_id", "n_bytes"])
    hashes = F.transform(F.array_distinct(F.transform("prints", lambda p: p.bitwiseAND(F.lit(0xFFFFFFFF)))), lambda p: F.hex(F.xxhash64(p)))
    feature = F.concat(F.size("prints").cast("string"), F.lit(":"), F.array_join(F.slice(F.array_sort(hashes), 1, pairs), ""))
    return rows.withColumn("feature", feature)
