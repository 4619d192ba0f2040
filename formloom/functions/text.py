"""Text functions: stripping, quoting, comparison form, tokens."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def held(struct: Column) -> Column:
    """The struct as a value of its own: the optimizer takes plain structs apart
    and writes their parts out wherever a field is used, many times over."""
    return F.element_at(F.array(struct), 1)


def let(value: Column, body) -> Column:
    """body(value), the value being worked out once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, SPACE, "")


def quoted(c: Column) -> Column:
    """The string as a quoted literal, as error messages show values."""
    body = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    single = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    double = F.concat(F.lit('"'), body, F.lit('"'))
    return F.when(F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"')), double).otherwise(single)


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """Compatibility form.  No built-in has it, so this is an Arrow UDF; text of
    ASCII alone is its own form (see `ascii_only`)."""
    return _nfkc(c)


def ascii_only(c: Column) -> Column:
    return ~F.rlike(c, F.lit(r"[^\x00-\x7F]"))


def comparison_form(c: Column, composed: bool = False) -> Column:
    """Case, white space, look-alike and separator marks do not count.
    `composed` says that the text is in compatibility form already."""
    s = c if composed else nfkc(c)
    s = F.translate(s, "’‘–—×", "''--x")
    s = F.regexp_replace(s, r"[.,;:\-'’]", " ")
    s = F.regexp_replace(s, r"(?U)[\s\x1c-\x1f]+", " ")
    return F.lower(F.trim(s))


def token_set(c: Column, composed: bool = False) -> Column:
    s = c if composed else nfkc(c)
    return F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9]+"), F.lit(0)))


def covers(gold: Column, got: Column, share: float = 0.6) -> Column:
    """At least `share` of the gold tokens are among the other's; no gold
    tokens: false."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(gold, got)), F.size(gold)) >= share, F.lit(False))


def first_word(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "[A-Za-z]+", 0), F.lit(""))


def pair_id(stem: Column) -> Column:
    """Leading letters, underscore and number of a file name, or null."""
    return F.nullif(F.regexp_extract(stem, "^([A-Z]+_[0-9]+)", 1), F.lit(""))


def percent(num: Column, den: Column) -> Column:
    """Whole percent, halves to even; '-' without a denominator."""
    return F.when(den == 0, "-").otherwise(F.format_string("%.0f%%", F.bround(F.try_divide(num * 100.0, den), 0)))
