"""License scan with ordered signature rules, in DataFrame functions only.

Texts become lower-case (A-Z) words (letters, digits, non-ASCII characters), so
punctuation and line breaks do not matter.  A rule has keywords, a regex over
words joined by single spaces, a label, a priority (its place in RULES, lower is
stronger) and a confidence; every match of the regex has one of the keywords as
a word.  Only texts with a keyword are looked at further.

Such a text is cut between any two words that no rule has side by side.  No
match crosses a cut, so the segments that have a keyword are all that is left to
scan; equal segments are scanned once.  However long the text, a segment has few
words, unless words of many rules run on into each other without end.
In a segment, rules whose keyword it has are tried.  Detections are intervals;
one is suppressed by another that

* contains it and is longer, or
* covers the same interval with a stronger priority, or
* overlaps it in part with a stronger priority.

Everything happens within a row: no shuffle, no Python; the work grows with the
number of words.

Defined cases: null text counts as empty; no words: zero counts, null places,
empty labels, score 0; repeated rows give equal values; other columns are
ignored.
"""

from __future__ import annotations

import functools
import itertools
import json
import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]+"

#: Phrases that are always looked for, and their labels.
BASE = (
    (("cc", "by"), "cc-by"),
    (("general", "public", "license"), "gpl"),
    (("all", "rights", "reserved"), "reserved"),
)
#: Each base phrase has one of these words.
BASE_KEYWORDS = ("cc", "license", "reserved")


LICENSE = ("license", "licence")


class Rule(NamedTuple):
    keywords: tuple[str, ...]
    #: Literals, [..], (?:..|..), ? and \\d alone, so that its phrases can be listed.
    regex: str
    label: str
    confidence: float


def _spdx(name: str) -> str:
    return rf"spdx licen[sc]e identifier {name}"


def _gnu_rules() -> list[Rule]:
    names = {
        "agpl": r"(?:gnu )?affero general public licen[sc]e",
        "lgpl": r"(?:gnu )?(?:lesser|library) general public licen[sc]e",
        "gpl": r"(?:gnu )?general public licen[sc]e",
    }
    versions = {"agpl": ("1", "3"), "lgpl": ("2", "2 1", "3"), "gpl": ("1", "2", "3")}
    out = []
    for short, long in names.items():
        for v in sorted(versions[short], key=len, reverse=True):
            number = v if " " in v else f"{v}(?: 0)?"
            dotted = v.replace(" ", ".") if " " in v else f"{v}.0"
            at = rf"(?: as published by the free software foundation)?(?: either)?(?: (?:version|v))? ?(?:v)?{number}"
            later = r"(?: of the licen[sc]e)? or(?: at your option)? (?:any )?(?:later|newer)(?: version)?"
            forms = ((rf"{long}{at}", "license", 0.95), (rf"(?:gnu )?{short}(?: (?:version|v))? ?v?{number}", short, 0.85), (_spdx(rf"{short} {number}"), "spdx", 1.0))
            for regex, keyword, sure in forms:
                words = LICENSE if keyword == "license" else (keyword,)
                # The version may be written to the word, as in gplv3.
                joined = () if keyword == "spdx" else tuple(f"{w}{x}{number[0]}" for w in words for x in ("v", ""))
                out.append(Rule((*words, *joined), rf"{regex}(?:{later}| or later)", f"{short}-{dotted}-or-later", sure))
                out.append(Rule((*words, *joined), rf"{regex}(?: only)?", f"{short}-{dotted}", sure))
        out.append(Rule(LICENSE, long, short, 0.8))
        out.append(Rule((short,), rf"(?:gnu )?{short}(?: licen[sc]ed?)?", short, 0.6))
    return out


def _cc_rules() -> list[Rule]:
    parts = {"nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?", "sa": "share ?alike"}
    kinds = (("nc", "sa"), ("nc", "nd"), ("nc",), ("nd",), ("sa",), ())
    out = []
    for v in ("4 0", "3 0", "2 5", "2 0", "1 0", ""):
        for kind in kinds:
            short = " ".join(("by", *kind))
            long = " ".join(("attribution", *(parts[k] for k in kind)))
            label = "-".join(("cc", "by", *kind)) + (f"-{v.replace(' ', '.')}" if v else "")
            tail, name = (rf" (?:v |version )?{v}", rf"(?: international| unported| generic| public)?") if v else ("", "")
            out.append(Rule(("spdx",), _spdx(rf"cc {short}{tail}"), label, 1.0))
            out.append(Rule(("creativecommons",), rf"creativecommons org licenses {short}{tail}", label, 1.0))
            out.append(Rule(("creative",), rf"creative commons {long}{tail}{name} licen[sc]e", label, 0.95))
            out.append(Rule(("creative",), rf"creative commons {long}(?: licen[sc]e)?{tail}{name}", label, 0.95))
            out.append(Rule(("cc",), rf"cc {short}{tail}{name}", label, 0.9))
    out += [
        Rule(("cc0",), r"cc0(?: 1 0)?(?: universal)?", "cc0-1.0", 0.95),
        Rule(("creativecommons",), r"creativecommons org publicdomain zero 1 0", "cc0-1.0", 1.0),
        Rule(("creative",), r"creative commons zero(?: v?1 0)?(?: universal)?", "cc0-1.0", 0.95),
    ]
    return out


def _named_rules() -> list[Rule]:
    """Licenses with a name and versions: (label, name, abbreviation, versions)."""
    families = (
        ("apache", r"apache (?:software )?licen[sc]e", "apache", ("2 0", "1 1", "1 0")),
        ("mpl", r"mozilla public licen[sc]e", "mpl", ("2 0", "1 1", "1 0")),
        ("epl", r"eclipse public licen[sc]e", "epl", ("2 0", "1 0")),
        ("cddl", r"common development and distribution licen[sc]e", "cddl", ("1 1", "1 0")),
        ("eupl", r"european union public licen[sc]e", "eupl", ("1 2", "1 1", "1 0")),
        ("artistic", r"artistic licen[sc]e", "artistic", ("2 0", "1 0")),
        ("osl", r"open software licen[sc]e", "osl", ("3 0", "2 1", "2 0", "1 1", "1 0")),
        ("afl", r"academic free licen[sc]e", "afl", ("3 0", "2 1", "2 0", "1 2", "1 1")),
        ("lppl", r"latex project public licen[sc]e", "lppl", ("1 3c", "1 3", "1 2", "1 0")),
        ("ms-pl", r"microsoft public licen[sc]e", "ms pl", ()),
        ("bsl", r"boost software licen[sc]e", "bsl", ("1 0",)),
        ("ofl", r"(?:sil )?open font licen[sc]e", "ofl", ("1 1", "1 0")),
        ("odbl", r"open (?:data commons open )?database licen[sc]e", "odbl", ("1 0",)),
        ("zpl", r"zope public licen[sc]e", "zpl", ("2 1", "2 0", "1 1")),
        ("psf", r"python software foundation licen[sc]e", "psf", ("2 0",)),
        ("cecill", r"cecill(?: free software)? licen[sc]e", "cecill", ("2 1", "2 0", "1 0")),
        ("upl", r"universal permissive licen[sc]e", "upl", ("1 0",)),
        ("rail", r"(?:open )?(?:responsible ai|rail)(?: m)? licen[sc]e", "openrail", ()),
    )
    out = []
    for label, name, short, versions in families:
        key = short.split()[0]
        for v in (*versions, ""):
            tail = rf"(?: (?:version|v))? v?{v}" if v else ""
            full = f"{label}-{v.replace(' ', '.')}" if v else label
            out.append(Rule(LICENSE, rf"(?:the )?{name}{tail}", full, 0.95 if v else 0.8))
            out.append(Rule(("spdx",), _spdx(rf"{short}{tail}"), full, 1.0))
            if v:
                out.append(Rule((key,), rf"{short}{tail}", full, 0.8))
    return out


def _clause_rules() -> list[Rule]:
    out = []
    words = {"0": "zero", "1": "one", "2": "two", "3": "three", "4": "four"}
    other = {"2": "simplified|freebsd", "3": "new|modified|revised", "4": "original|old"}
    for n, word in words.items():
        names = rf"(?:{n}|{word}) clause" + (rf"|{other[n]}" if n in other else "")
        out.append(Rule(("bsd",), rf"(?:{names}) bsd(?: style)?(?: licen[sc]e)?", f"bsd-{n}-clause", 0.95))
        out.append(Rule(("bsd",), rf"bsd (?:{names})(?: licen[sc]e)?", f"bsd-{n}-clause", 0.95))
    out.append(Rule(("bsd",), r"bsd(?: style)? licen[sc]ed?", "bsd", 0.8))
    out += [
        Rule(LICENSE, r"(?:the )?mit 0 licen[sc]e", "mit-0", 0.95),
        Rule(LICENSE, r"(?:the )?(?:mit|expat|mit x11)(?: style)? licen[sc]e", "mit", 0.95),
        Rule(("licensed", "licenced"), r"licen[sc]ed under(?: the)? (?:mit|expat)", "mit", 0.9),
        Rule(LICENSE, r"(?:the )?isc licen[sc]e", "isc", 0.95),
        Rule(LICENSE, r"(?:the )?(?:zlib|libpng)(?: libpng)? licen[sc]e", "zlib", 0.95),
        Rule(("unlicense", "unlicence"), r"(?:the )?unlicen[sc]e", "unlicense", 0.95),
        Rule(LICENSE, r"(?:the )?beerware licen[sc]e", "beerware", 0.9),
        Rule(LICENSE, r"do what the f(?:uck|ck| ck| k)? you want to public licen[sc]e", "wtfpl", 0.95),
        Rule(("spdx",), _spdx("mit"), "mit", 1.0),
        Rule(("spdx",), _spdx("isc"), "isc", 1.0),
        Rule(("spdx",), _spdx("zlib"), "zlib", 1.0),
        Rule(("wtfpl",), r"wtfpl", "wtfpl", 0.9),
        Rule(("granted",), r"permission is hereby granted free of charge to any person obtaining a copy", "mit", 0.9),
        Rule(("redistribution",), r"redistribution and use in source and binary forms with or without modification are permitted", "bsd", 0.9),
        Rule(("permission",), r"permission to use copy modify and or distribute this software for any purpose", "isc", 0.9),
    ]
    return out


def _notice_rules() -> list[Rule]:
    return [
        Rule(("domain",), r"(?:released|dedicated|placed) (?:in)?to the public domain", "public-domain", 0.9),
        Rule(("domain",), r"in the public domain", "public-domain", 0.7),
        Rule(("reserved",), r"all rights reserved", "reserved", 0.7),
        Rule(("reserved",), r"(?:no|some) rights reserved", "rights-notice", 0.5),
        Rule(("proprietary",), r"proprietary and confidential", "proprietary", 0.8),
        Rule(("permission",), r"(?:used|reprinted|reproduced) (?:with|by) permission", "by-permission", 0.6),
        Rule(("copyright",), r"copyright(?: c)? (?:19|20)\d\d", "copyright", 0.4),
        Rule(("commercial", "noncommercial"), r"(?:for )?non ?commercial use only", "non-commercial", 0.6),
        Rule(("educational",), r"for educational (?:use|purposes) only", "educational-use", 0.5),
    ]


#: In order of priority.
RULES: tuple[Rule, ...] = tuple(_cc_rules() + _gnu_rules() + _named_rules() + _clause_rules() + _notice_rules())


def phrases(regex: str) -> list[str]:
    """Every text that a rule's regex matches."""

    def branches(i: int) -> tuple[list[str], int]:
        found, i = sequence(i)
        while i < len(regex) and regex[i] == "|":
            more, i = sequence(i + 1)
            found = found + more
        return found, i

    def sequence(i: int) -> tuple[list[str], int]:
        done = [""]
        while i < len(regex) and regex[i] not in "|)":
            if regex.startswith("(?:", i):
                part, i = branches(i + 3)
                i += 1
            elif regex[i] == "[":
                end = regex.index("]", i)
                part, i = list(regex[i + 1 : end]), end + 1
            elif regex.startswith(r"\d", i):
                part, i = list(string.digits), i + 2
            elif regex[i].isalnum() or regex[i] == " ":
                part, i = [regex[i]], i + 1
            else:
                raise ValueError(f"not in a rule: {regex[i:]}")
            if regex[i : i + 1] == "?":
                part, i = part + [""], i + 1
            done = [a + b for a in done for b in part]
        return done, i

    return branches(0)[0]


@functools.cache
def neighbours(rules: tuple[Rule, ...]) -> frozenset[str]:
    """All 'a b' such that some rule matches a text with the words a b."""
    return frozenset(" ".join(pair) for regex in {r.regex for r in rules} for text in phrases(regex) for pair in itertools.pairwise(text.split(" ")))


def _places(words: Column, phrase: tuple[str, ...]) -> Column:
    """Word numbers at which the phrase stands."""
    starts = F.sequence(F.lit(0), F.size(words) - 1)

    def here(i):
        ok = F.get(words, i) == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            ok = ok & (F.coalesce(F.get(words, i + k), F.lit("")) == w)
        return ok

    return F.filter(starts, here)


def _intervals(text: Column, rule: Column) -> Column:
    """struct(lo, hi, rank, label, sure) of each match of the rule."""
    found = F.regexp_extract_all(text, rule["regex"], F.lit(0))
    between = F.split(text, rule["regex"])

    def one(m, i):
        before = F.aggregate(F.slice(between, 1, i + 1), F.lit(0), lambda s, x: s + F.length(x))
        lo = before + F.aggregate(F.slice(found, 1, i), F.lit(0), lambda s, x: s + F.length(x))
        return F.struct(lo.alias("lo"), (lo + F.length(m)).alias("hi"), rule["rank"].alias("rank"), rule["label"].alias("label"), rule["sure"].alias("sure"))

    return F.transform(found, one)


def _suppressed(d: Column, e: Column) -> Column:
    contains = (e["lo"] <= d["lo"]) & (e["hi"] >= d["hi"])
    longer = (e["hi"] - e["lo"]) > (d["hi"] - d["lo"])
    overlap = (e["lo"] < d["hi"]) & (d["lo"] < e["hi"])
    inside = (d["lo"] <= e["lo"]) & (d["hi"] >= e["hi"])
    return (contains & (longer | (e["rank"] < d["rank"]))) | (overlap & ~contains & ~inside & (e["rank"] < d["rank"]))


def let(value: Column, body) -> Column:
    """body(value), the value being worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def detections(text: Column, rules=RULES) -> Column:
    """Detections that stand after suppression in a segment, which is words
    joined by single spaces, with one before and behind."""
    by_keyword: dict[str, list] = {}
    for rank, r in enumerate(rules):
        for k in r.keywords:
            by_keyword.setdefault(k, []).append({"regex": f"(?<= ){r.regex}(?= )", "label": r.label, "rank": rank, "sure": r.confidence})
    # A literal: it is folded when the query is planned.
    table = F.from_json(F.lit(json.dumps(by_keyword)), "map<string,array<struct<regex:string,label:string,rank:int,sure:double>>>")
    keys = F.array_intersect(F.split(text, " "), F.map_keys(table))
    tried = F.array_distinct(F.flatten(F.transform(keys, lambda k: F.element_at(table, k))))
    found = F.flatten(F.transform(F.filter(tried, lambda r: F.rlike(text, r["regex"])), lambda r: _intervals(text, r)))
    return let(found, lambda each: F.filter(each, lambda d: ~F.exists(each, lambda e: _suppressed(d, e))))


def segments(words: str, rules=RULES) -> Column:
    """'number word word ...' of each segment that has a keyword, the number
    being that of its first word in the array column `words`."""
    pairs = ", ".join(f"'{p}'" for p in sorted(neighbours(tuple(rules))))
    marked = F.expr(f"transform({words}, (w, i) -> CASE WHEN concat(get({words}, i - 1), ' ', w) IN ({pairs}) THEN concat(' ', w) ELSE concat('\\n', CAST(i AS STRING), ' ', w) END)")
    gate = "|".join(sorted({k for r in rules for k in r.keywords}))
    return F.filter(F.split(F.array_join(marked, ""), "\n"), lambda s: F.rlike(s, F.lit(f" (?:{gate})(?: |$)")))


def _span(start: Column, text: Column, d: Column) -> Column:
    """A detection's place by words: lo, hi (behind its last word) and label."""
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    lo = start + spaces(F.substring(text, F.lit(1), d["lo"])) - 1
    return F.struct(lo.alias("lo"), (lo + spaces(F.substring(text, d["lo"] + 1, d["hi"] - d["lo"])) + 1).alias("hi"), d["label"].alias("label"))


def scan_licenses(docs: DataFrame, rules=RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_words, n_base, first_word, last_word, base_labels, labels,
    score and spans (lo, hi, label, by words) of each document."""
    keywords = sorted({k for r in rules for k in r.keywords} | set(BASE_KEYWORDS))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # A-Z alone.  Other letters may change their case too, as no rule has them,
    # but for two that become ASCII.
    exact = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    low = F.when(F.rlike(text, F.lit("[\u0130\u212a]")), exact).otherwise(F.lower(text))
    rows = docs.select(*keep, F.regexp_extract_all(low, F.lit(WORD), F.lit(0)).alias("_words"))
    rows = rows.select(*keep, F.size("_words").cast("long").alias("n_words"), F.array_intersect("_words", F.array(*map(F.lit, keywords))).alias("_keys"), "_words")
    # Texts without a keyword need their words no longer.
    rows = rows.withColumn("_words", F.when(F.size("_keys") > 0, F.col("_words")))
    gate = F.arrays_overlap("_keys", F.array(*map(F.lit, BASE_KEYWORDS)))
    for k, (phrase, _) in enumerate(BASE):
        rows = rows.withColumn(f"_at{k}", F.when(gate, _places(F.col("_words"), phrase)).otherwise(F.array().cast("array<int>")))
    at = F.concat(*[F.col(f"_at{k}") for k in range(len(BASE))])
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"_at{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)])))
    rows = rows.withColumn("_at", at).withColumn("_base", base)
    rows = rows.withColumn("_parts", F.when(F.size("_keys") > 0, segments("_words", rules)))
    body = lambda s: F.concat(F.lit(" "), F.substring(s, F.instr(s, F.lit(" ")) + 1, F.length(s)), F.lit(" "))
    rows = rows.withColumn("_kept", F.flatten(F.transform(F.array_distinct(F.transform("_parts", body)), lambda t: detections(t, rules))))
    empty = F.array().cast("array<string>")
    labels = F.array_sort(F.array_distinct(F.concat("_base", F.coalesce(F.transform("_kept", lambda d: d["label"]), empty))))
    best = F.coalesce(F.array_max(F.transform("_kept", lambda d: d["sure"])), F.lit(0.0))

    def placed(s):
        start = F.substring_index(s, " ", 1).cast("int")
        return let(body(s), lambda t: F.transform(detections(t, rules), lambda d: _span(start, t, d)))

    return rows.select(
        *keep,
        "n_words",
        F.size("_at").cast("long").alias("n_base"),
        F.array_min("_at").cast("long").alias("first_word"),
        F.array_max("_at").cast("long").alias("last_word"),
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(best, F.when(F.size("_base") > 0, 0.5).otherwise(0.0)).alias("score"),
        F.flatten(F.transform("_parts", placed)).alias("spans"),
    )
