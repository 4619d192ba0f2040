"""DuckDB SQL of the operators that SQL expresses in full."""

from __future__ import annotations

_ESCAPED = r"regexp_replace({c}, '(\\*)(</?s>|\[/?INST\]|<</?SYS>>)', '\\\1\2', 'g')"

OP3 = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
g AS (SELECT doc_id, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT p.a, p.b FROM pairs p JOIN sets x ON x.doc_id = p.a JOIN sets y ON y.doc_id = p.b WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY 1) r ON r.a = s.doc_id
"""

OP4 = rf"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
    CAST(sum(length(role) + length({_ESCAPED.format(c="text")}) + length('<s>' || chr(10) || chr(10) || '</s>')) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def license_scan_sql() -> str:
    """SQL of the license scan.  The rules' regexes come from the operator, put
    for text with two spaces between words, so that a match can take one on
    either side; gates, places and suppression are written anew."""
    from .op02_license import BASE, RULES

    def quote(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def wide(regex: str) -> str:
        return " (?:" + regex.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?") + ") "

    rules = ",\n".join(f"({i}, [{', '.join(map(quote, r.keywords))}], {quote(wide(r.regex))}, {quote(r.label)}, {r.confidence})" for i, r in enumerate(RULES))
    places = " || ".join(
        f"list_filter(range(1, len(w) + 1), lambda i: {' AND '.join(f'w[i + {k}] IS NOT DISTINCT FROM {quote(word)}' for k, word in enumerate(phrase))})" for phrase, _ in BASE
    )
    marks = ", ".join(f"CASE WHEN contains(single, {quote(' ' + ' '.join(phrase) + ' ')}) THEN {quote(label)} END" for phrase, label in BASE)
    return rf"""
WITH rules(rank, keywords, regex, label, sure) AS (VALUES {rules}),
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
texts AS (SELECT doc_id, w, ' ' || array_to_string(w, '  ') || ' ' AS t, ' ' || array_to_string(w, ' ') || ' ' AS single FROM words),
base AS (SELECT doc_id, {places} AS spots, list_filter([{marks}], lambda x: x IS NOT NULL) AS base FROM texts),
tried AS (SELECT doc_id, rank, label, sure, regexp_extract_all(t, regex) AS m, string_split_regex(t, regex) AS p FROM texts JOIN rules ON list_has_any(w, keywords)),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM tried WHERE len(m) > 0),
found AS (SELECT doc_id, rank, label, sure, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS lo, length(m[i]) AS n FROM each),
d AS (SELECT *, lo + n AS hi FROM found),
kept AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.doc_id = d.doc_id AND (
    (e.lo <= d.lo AND e.hi >= d.hi AND (e.n > d.n OR e.rank < d.rank))
    OR (e.lo < d.hi AND d.lo < e.hi AND NOT (e.lo <= d.lo AND e.hi >= d.hi) AND NOT (d.lo <= e.lo AND d.hi >= e.hi) AND e.rank < d.rank)))),
best AS (SELECT doc_id, max(sure) AS sure, list(label) AS labels FROM kept GROUP BY 1)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(spots) AS BIGINT) AS n_base, CAST(list_min(spots) - 1 AS BIGINT) AS first_word, CAST(list_max(spots) - 1 AS BIGINT) AS last_word,
    array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(base || coalesce(labels, []))), ',') AS labels,
    CAST(greatest(coalesce(sure, 0), CASE WHEN len(base) > 0 THEN 0.5 ELSE 0 END) AS DOUBLE) AS score
FROM texts t JOIN base USING (doc_id) LEFT JOIN best USING (doc_id)
"""
