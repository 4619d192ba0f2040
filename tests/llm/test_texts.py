"""License scan, near duplicates, fingerprints and audio against brute force."""

import hashlib
import io
import re
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from formloom.llm import op02_license as lic
from formloom.llm import op03_jaccard_join as near
from formloom.llm import op06_lz_fingerprint as lz
from formloom.llm import op10_audio as audio
from formloom.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# ---------------------------------------------------------------- licenses

def scan(text):
    """The rules applied one by one, and suppression by comparing all."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    base, places = set(), []
    for phrase, label in lic.BASE:
        found = [i for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase]
        places += found
        if found:
            base.add(label)
    joined, found = " " + " ".join(words) + " ", []
    for rank, r in enumerate(lic.RULES):
        if not set(words).isdisjoint(r.keywords):
            found += [(m.start(), m.end(), rank, r.label, r.confidence) for m in re.finditer(f"(?<= ){r.regex}(?= )", joined)]

    def loses(d, e):
        contains = e[0] <= d[0] and e[1] >= d[1]
        inside = d[0] <= e[0] and d[1] >= e[1]
        overlap = e[0] < d[1] and d[0] < e[1]
        return (contains and (e[1] - e[0] > d[1] - d[0] or e[2] < d[2])) or (overlap and not contains and not inside and e[2] < d[2])

    kept = [d for d in found if not any(loses(d, e) for e in found)]
    score = max([d[4] for d in kept] + [0.5 if base else 0.0])
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {d[3] for d in kept})), score


LICENSED = [
    "Licensed under CC BY-NC 4.0.", "CC-BY, cc by and CC_BY by CC", "the GNU General Public License, version 3.", "GNU Lesser General Public License v2.1 or later", "GNU Affero General Public License version 3 only",
    "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the MIT License. All rights reserved. All rights reserved", "mit der Zeit", "BSD 3-Clause License", "https://creativecommons.org/licenses/by-sa/4.0/",
    "Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under the Apache License, Version 2.0", "all  RIGHTS\nreserved ccby", "general public", "", None, "É cc bÿ by cc by", "Dual: MIT License or Apache-2.0; public domain in the public domain",
]


def read_scan(df):
    return {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in df.collect()}


def test_op2_rules(spark):
    df = spark.createDataFrame(list(enumerate(LICENSED)), "doc_id long, text string")
    got = read_scan(lic.scan_licenses(df))
    for i, text in enumerate(LICENSED):
        assert got[i] == scan(text), text
    assert "gpl-3.0" in got[2][5] and got[3][5] == "gpl,lgpl-2.1-or-later" and got[9][5] == "cc-by-sa-4.0" and got[7][5] == ""


def test_op2_table(run, documents):
    got = {r.doc_id: r for r in run("op2_license_scan").itertuples()}
    for r in documents.collect():
        w, g = scan(r.text), got[r.doc_id]
        none = lambda x: None if x != x else x
        assert (g.n_words, g.n_base, none(g.first_word), none(g.last_word), g.base_labels, g.labels, g.score) == w


def test_op2_edges(edge, empty):
    got = lic.scan_licenses(edge).collect()
    assert len(got) == edge.count() and lic.scan_licenses(empty).count() == 0
    want = sorted((r.doc_id or -1, scan(r.text)[0]) for r in edge.collect())
    assert sorted((r.doc_id or -1, r.n_words) for r in got) == want


JOINED = [
    "licensed under GPLv3", "GPLv2+ code", "the gpl3 or later", "LGPLv3 only", "lgplv2.1", "AGPLv3", "agpl1", "GNU General Public License3", "GNU Lesser General Public Licencev2.1 or later",
    "noncommercial use only", "for non-commercial use only", "licenced under the MIT", "licenced under the MIT 0 License", "The Unlicense", "the unlicence", "gpl v3 and GPLv2",
]


def matches_of(tree):
    """Every text that a parsed regex matches, words of any length and digits
    once."""
    texts = [""]
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            more = [chr(arg)]
        elif op == "IN":
            more = [chr(a) for o, a in arg if str(o) == "LITERAL"] or ["1"]
        elif op == "MAX_REPEAT":
            more = ["", *matches_of(arg[2])] if arg[0] == 0 else matches_of(arg[2])
        elif op == "SUBPATTERN":
            more = matches_of(arg[3])
        else:
            assert op == "BRANCH", op
            more = [x for part in arg[1] for x in matches_of(part)]
        texts = [a + b for a in texts for b in more]
    return texts


def test_op2_every_match_has_a_keyword():
    for r in lic.RULES:
        every = lic.phrases(r.regex)
        assert set(every) == set(matches_of(re._parser.parse(r.regex.replace(r"\d", "[0123456789]"))))
        missed = [x for x in every if set(r.keywords).isdisjoint(x.split(" "))]
        assert not missed, (r.regex, missed[:3])
    assert len({r.regex for r in lic.RULES}) == len(lic.RULES) > 300


#: Labels by hand, apart from the rules.
EXPECTED = {
    "Apache License, Version 2.0": "apache-2.0", "the Apache Software License 1.1": "apache-1.1", "Mozilla Public License v2.0": "mpl-2.0", "MPL 1.1": "mpl-1.1", "Eclipse Public License": "epl",
    "Boost Software License - Version 1.0": "bsl-1.0", "SIL Open Font License 1.1": "ofl-1.1", "European Union Public Licence 1.2": "eupl-1.2", "Artistic License 2.0": "artistic-2.0", "PSF 2.0": "psf-2.0",
    "2-clause BSD license": "bsd-2-clause", "the new BSD licence": "bsd-3-clause", "BSD-style license": "bsd", "the MIT License (MIT)": "mit", "MIT-0 License": "mit-0", "ISC license": "isc", "zlib/libpng license": "zlib", "This is the Unlicense": "unlicense",
    "CC0 1.0 Universal": "cc0-1.0", "CC-BY-SA 3.0 unported": "cc-by,cc-by-sa-3.0", "CC BY-NC-ND 4.0": "cc-by,cc-by-nc-nd-4.0", "Creative Commons Attribution-NonCommercial 2.5 License": "cc-by-nc-2.5",
    "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: LGPL-2.1-only": "lgpl-2.1", "SPDX-License-Identifier: Apache-2.0": "apache-2.0", "GPLv2 or any later version": "gpl-2.0-or-later", "GNU General Public License": "gpl",
    "GNU Affero General Public Licence v3.0 or later": "agpl-3.0-or-later", "some rights reserved": "rights-notice", "placed into the public domain": "public-domain", "Copyright (c) 2019": "copyright", "reprinted by permission": "by-permission",
    "for educational purposes only": "educational-use", "permission is hereby granted, free of charge, to any person obtaining a copy": "mit", "do what the f*** you want to public license": "wtfpl", "license to print": "", "domain": "", "under CC by the sea": "cc-by",
    "CC BY-shareali\u212ae 4.0": "cc-by", "non-commerc\u0130al use only": "", "ALL R\u0130GHTS RESERVED": "",
}


def test_op2_labels_by_hand(spark):
    df = spark.createDataFrame([(i, f"xx {x}. yy") for i, x in enumerate(EXPECTED)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in lic.scan_licenses(df).collect()}
    assert {x: got[i] for i, x in enumerate(EXPECTED)} == EXPECTED


def test_op2_many_matches_in_one_text(spark):
    """Work in proportion to the matches, equal ones or not."""
    import time

    lic.neighbours(lic.RULES)
    texts = ["all rights reserved " * 100_000, " ".join(f"copyright {1900 + i % 200} gpl v{1 + i % 3} x{i}" for i in range(100_000)), "gpl 2 0 or later " * 50_000 + "cc by 4 0 " * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    df.count()
    lic.scan_licenses(df.limit(0)).drop("spans").collect()
    began = time.monotonic()
    got = read_scan(lic.scan_licenses(df).drop("spans"))
    took = time.monotonic() - began
    assert got[0][1:] == (100_000, 0, 299_997, "reserved", "reserved", 0.7) and got[1][5] == "copyright,gpl-1.0,gpl-2.0,gpl-3.0" and got[2][5] == "cc-by,cc-by-4.0,gpl-2.0-or-later"
    assert took < 30, took  # three texts


def test_op2_spans_are_words(spark):
    text = "one two CC BY-SA 4.0, three; the MIT license. Four all rights reserved"
    (row,) = lic.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    words = WORD.findall(text.lower())
    assert sorted((" ".join(words[s.lo : s.hi]), s.label) for s in row.spans) == [("all rights reserved", "reserved"), ("cc by sa 4 0", "cc-by-sa-4.0"), ("the mit license", "mit")]


def test_op2_gate_leaves_nothing_out(spark):
    texts = JOINED + [x or "" for x in LICENSED]
    df = spark.createDataFrame([(i, x + " anyword") for i, x in enumerate(texts)], "doc_id long, text string")
    read = lambda d: {r.doc_id: (r.labels, r.score, [tuple(x) for x in r.spans or ()]) for r in d.select("doc_id", "labels", "score", "spans").collect()}
    got = read(lic.scan_licenses(df))
    # Without cuts and keywords: rules one by one over whole texts.
    for i, text in enumerate(texts):
        w = scan(text + " anyword")
        assert got[i][:2] == w[5:], text
    assert [got[i][0] for i in (0, 1, 2, 4, 9, 11)] == ["gpl-3.0", "gpl-2.0", "gpl-3.0-or-later", "lgpl-2.1", "non-commercial", "mit"]


# ---------------------------------------------------------------- near duplicates

def sets_of(rows):
    out = []
    for d, text in rows:
        w = (text or "").encode().lower().split()
        s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        out.append((d, frozenset(s)))
    return out


def brute_groups(rows):
    docs = sets_of(rows)
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, x) in enumerate(docs):
        for j in range(i):
            y = docs[j][1]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    parent[max(find(i), find(j))] = min(find(i), find(j))
    big = 1 << 63
    low = {}
    for i, (d, s) in enumerate(docs):
        low[find(i)] = min(low.get(find(i), big), big if d is None else d)
    none = lambda x: None if x == big else x
    return sorted(((d, len(s), none(low[find(i)]) if s else d) for i, (d, s) in enumerate(docs)), key=str)


def read_groups(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_op3_table(spark, run, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in run("op3_jaccard_join").itertuples()), key=str)
    assert got == brute_groups(rows)


def test_op3_edges(edge, empty):
    assert read_groups(near.near_duplicate_groups(edge)) == brute_groups([(r.doc_id, r.text) for r in edge.collect()])
    assert near.near_duplicate_groups(empty).count() == 0


@pytest.fixture(scope="module")
def drift():
    """Chains of near copies, at and about the threshold, and a passage that
    many texts share."""
    rng = np.random.default_rng(11)
    passage = [f"p{i}" for i in range(50)]
    rows, base = [], [f"w{i}" for i in rng.integers(0, 10**6, 120)]
    for i in range(120):
        if i % 3 == 0:
            base = list(base)
            base[rng.integers(0, len(base))] = f"x{i}"
        text = list(base)
        for _ in range(rng.integers(0, 4)):
            text[rng.integers(0, len(text))] = f"y{rng.integers(0, 10**6)}"
        rows.append((1000 - i, " ".join(text[: rng.integers(90, 121)])))
    rows += [(2000 + i, " ".join([f"q{i}_{k}" for k in range(int(rng.integers(5, 60)))] + passage)) for i in range(80)]
    return rows


def test_op3_drifting_copies(spark, drift, monkeypatch):
    df = spark.createDataFrame(drift, "doc_id long, text string").repartition(5)
    want = brute_groups(drift)
    assert read_groups(near.near_duplicate_groups(df)) == want
    # Small blocks and buckets, groups that are dealt in rounds, ids by a join.
    for name, value in (("BUCKET_KEYS", 300), ("BLOCK_KEYS", 500), ("GROUP_KEYS", 2000), ("ROUNDS", 1), ("SLOT_BITS", 4)):
        monkeypatch.setattr(near, name, value)
    assert read_groups(near.near_duplicate_groups(df)) == want


def test_op3_large_group_is_dealt_once_a_round(spark, monkeypatch):
    """A group of several times GROUP_KEYS keys: each round sends each set once,
    in units of bounded size, and no key is left to be compared by parts."""
    rng = np.random.default_rng(2)
    base, rows = [f"w{i}" for i in range(100)], []
    for i in range(300):  # any two are linked
        text = list(base)
        text[rng.integers(0, 100)] = f"y{rng.integers(0, 30)}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(base[:20] + [f"z{i}_{k}" for k in range(60)])) for i in range(10)]
    sent, plain, parts = [], near.once_each, near.by_key

    def counted(postings, seed):
        units = plain(postings, seed).toPandas()
        size = postings.groupBy("v", "w").agg(F.max("size").alias("size")).toPandas()
        assert len(units) == len(size) == len(units[["v", "w"]].drop_duplicates())
        assert units.merge(size, on=["v", "w"]).groupby("unit")["size"].sum().max() <= 2 * 8000
        sent.append(len(units))
        return plain(postings, seed)

    monkeypatch.setattr(near, "GROUP_KEYS", 8000)
    monkeypatch.setattr(near, "once_each", counted)
    monkeypatch.setattr(near, "by_key", lambda postings: pytest.fail("keys left") or parts(postings))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert read_groups(near.near_duplicate_groups(df)) == brute_groups(rows)
    assert sent and sent == sorted(sent, reverse=True)


def test_op3_copy_before_keeper(spark):
    """A copy that is read before its set's keeper, in the slot of another id."""
    first, pairs = {}, []
    for i, slot in spark.range(1, 3_000).select("id", near._slot("id", 17)).collect():
        if first.setdefault(slot, i) != i:
            pairs.append((first[slot], i))
    assert pairs
    rows = []
    for k, (a, c) in enumerate(sorted(pairs)):
        text = [f"t{k}_{i}" for i in range(100)]
        rows += [(c, " ".join(text)), (-k, " ".join(text)), (a, " ".join(text[:98]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert read_groups(near.near_duplicate_groups(df)) == brute_groups(rows)


def test_op3_very_long_text(spark):
    """More keys of one text in one bucket than 16 bits count."""
    text = [f"w{i}" for i in range(200_000)]
    rows = [(6, " ".join(text)), (5, " ".join(text[:199_000])), (4, " ".join(text[:70_000])), (3, " ".join(text[1000:70_000])), (0, "a short text of seven words only")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert read_groups(near.near_duplicate_groups(df)) == brute_groups(rows)


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(int(a), int(b)) for a, b in rng.integers(5000, 5200, (90, 2))] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            parent[find(a)] = find(b)
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got) == set(parent)
    pairs = {}
    for x in got:
        assert pairs.setdefault(find(x), got[x]) == got[x]
    assert len(set(pairs.values())) == len(pairs)


# ---------------------------------------------------------------- fingerprints

def phrases(raw):
    seen, start = set(), 0
    for end in range(1, len(raw) + 1):
        if raw[start:end] not in seen:
            seen.add(raw[start:end])
            start = end
    return seen


def test_op6_table(run, documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    got = {r.doc_id: r for r in run("op6_lz_fingerprint").itertuples()}
    errors = []
    for i, (d, text) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        g = got[d]
        assert (g.n_chars, g.edited_sha256, g.fingerprint, g.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), lz.fingerprint(text), lz.fingerprint(edited))
        x, y, z = phrases(text.encode()), phrases(edited.encode()), phrases(nxt.encode())
        errors += [g.near_edited - len(x & y) / len(x | y), g.near_next - len(x & z) / len(x | z)]
    assert np.abs(errors).max() < 0.2 and abs(np.mean(errors)) < 0.01


def test_op6_edges(edge, empty):
    got = lz.neighbour_likeness(edge, range_bytes=1000).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in edge.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert len(got) == len(rows)
    by = sorted((r.doc_id or -1, r.n_chars, r.fingerprint) for r in got)
    assert by == sorted((d or -1, len(t), lz.fingerprint(t)) for d, t in rows)
    want = {}
    for i, (d, t) in enumerate(rows):
        nxt, half = rows[(i + 1) % len(rows)][1], len(t) // 2
        want.setdefault((d, len(t)), []).append(hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest())
    have = {}
    for r in got:
        have.setdefault((r.doc_id, r.n_chars), []).append(r.edited_sha256)
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert lz.neighbour_likeness(empty).count() == 0


def test_op6_id_that_many_rows_share(spark):
    """Its texts are dealt to several ranges, in order."""
    rng = np.random.default_rng(6)
    rows = [(None if i % 2 else 7 if i % 3 else i, "".join(map(chr, rng.integers(97, 123, 40))) + "x" * 400) for i in range(600)] + [(None, "same " * 90)] * 50 + [(10_000 + i, "t" * i) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keyed = df.withColumn("_key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    ends, splits = lz.id_ranges(keyed, 20_000)
    assert set(splits) == {-(1 << 63), 7} and all(x == sorted(x) and len(x) >= 2 for x in splits.values()) and (ends[1:] >= ends[:-1]).all()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        want.append((d or -1, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()).hexdigest()))
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in lz.neighbour_likeness(df, range_bytes=20_000).collect()) == sorted(want)


def test_likeness():
    a = np.arange(10, dtype=np.uint32)
    assert lz.likeness(a, a) == 1.0 and lz.likeness(a, a[:0]) == 0.0 and lz.likeness(a[:0], a[:0]) == 1.0
    assert lz.likeness(a, a + 5, 128) == pytest.approx(5 / 15)
    assert lz.fingerprint("abcabc") == lz.fingerprint("abcabc") != lz.fingerprint("abcabd")


# ---------------------------------------------------------------- audio

def test_op10_table(run, documents):
    got = {r.doc_id: r for r in run("op10_audio_prints").itertuples()}
    for r in documents.collect():
        raw, g = r.text.encode(), got[r.doc_id]
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        media = audio.wav_bytes(payload)
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (g.media_bytes, g.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        with wave.open(io.BytesIO(media)) as w:
            assert (w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())) == (1, 1, payload)
    same = documents.toPandas().merge(run("op10_audio_prints"), on="doc_id").groupby("text").feature.nunique()
    assert same.max() == 1


def test_prints_of_tones():
    t = np.arange(audio.RATE) / audio.RATE
    tone = lambda f: (128 + 60 * np.sin(2 * np.pi * f * t)).astype(np.uint8).tobytes()
    at, bins = audio.spectral_peaks(tone(1000))
    strongest = {}
    for a, b in zip(at, bins):
        strongest.setdefault(int(a), []).append(int(b))
    want = round(1000 * audio.FRAME / audio.RATE)
    assert all(want in b for b in strongest.values())
    prints = audio.peak_pairs(at, bins)
    assert (np.diff(prints) >= 0).all() and ((prints & 0xFF) <= audio.AHEAD).all() and ((prints & 0xFF) > 0).all()
    assert len(audio.peak_pairs(*audio.spectral_peaks(b"\xff" * 576))) == 0


def test_peaks_and_pairs_by_direct_transform():
    """Peaks of a transform by its definition, and pairs of peaks one by one."""
    rng = np.random.default_rng(8)
    for n in (1, 100, 576, 2000):
        samples = rng.integers(32, 127, n).astype(np.uint8)
        x = np.pad(samples.astype(float) - 128, (0, max(0, audio.FRAME - n)))
        k, t = np.arange(audio.FRAME // 2 + 1)[:, None], np.arange(audio.FRAME)
        turns = np.exp(-2j * np.pi * k * t / audio.FRAME)
        window = 0.5 - 0.5 * np.cos(2 * np.pi * t / (audio.FRAME - 1))
        want = []
        for f, lo in enumerate(range(0, len(x) - audio.FRAME + 1, audio.HOP)):
            part = x[lo : lo + audio.FRAME]
            power = [round(abs((row * (part - part.mean()) * window).sum()) ** 2) for row in turns]
            tops = [b for b in range(1, len(power) - 1) if power[b] > power[b - 1] and power[b] >= power[b + 1] and power[b] > 0]
            want += sorted((f, b) for b in sorted(tops, key=lambda b: -power[b])[: audio.PEAKS])
        at, bins = audio.spectral_peaks(samples.tobytes())
        assert list(zip(at.tolist(), bins.tolist())) == want
        pairs = []
        for i, (f, b) in enumerate(want):
            later = [p for p in want if p[0] > f][: audio.PARTNERS]
            pairs += [(f << 32) | (b << 20) | (c << 8) | (g - f) for g, c in later if g - f <= audio.AHEAD]
        assert audio.peak_pairs(at, bins).tolist() == sorted(pairs)


def test_op10_edges(spark, edge, empty):
    got = audio.audio_digest(edge).collect()
    assert len(got) == edge.count() and audio.audio_digest(empty).count() == 0
    assert {r.n_bytes: r.payload_bytes for r in got}[0] == 576
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"RIFFxxxx")), (3, bytearray(audio.wav_bytes(b"a" * 576)))], "doc_id long, media binary")
    rows = {r.doc_id: r for r in audio.media_prints(odd, ["doc_id"]).collect()}
    assert rows[1].media_bytes is None and rows[2].payload_bytes is None and rows[2].prints == [] and rows[3].payload_bytes == 576
