"""Repair-parsing of model output to a JSON object, and the reply envelope.

Text that parses as an object as it stands (nearly all of it) stays on built-in
functions.  The rest goes to an Arrow UDF that tries, in order: the text, the
text without think blocks, the bodies of fences, the first balanced object of
each, and each of these without trailing commas.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What is looked for in model output.
FENCE = re.compile(r"```(?:[a-zA-Z0-9_-]+)?\s*\n?(.*?)```", re.DOTALL)
THINK = re.compile(r"<think>.*?</think>", re.DOTALL)
TRAILING_COMMA = re.compile(r",\s*([}\]])")
_QUOTED_OR_BRACE = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.DOTALL)


def balanced_object(text: str) -> str | None:
    """The span from the first brace to the one that closes it; braces inside
    strings do not count."""
    begin, depth = text.find("{"), 0
    if begin < 0:
        return None
    for m in _QUOTED_OR_BRACE.finditer(text, begin):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth == 0:
                between = text[begin : m.end()]
                return None if _has_open_quote(between) else between
    return None


def _has_open_quote(span: str) -> bool:
    rest = re.sub(r'"(?:[^"\\]|\\.)*"', "", span, flags=re.DOTALL)
    return '"' in rest


def candidates(text: str):
    """Texts to try, in order, without repeats."""
    tried = [text]
    thought = THINK.sub("", text)
    if thought != text:
        tried.append(thought)
    tried += [body for t in list(tried) for body in FENCE.findall(t)]
    for make in (balanced_object, lambda t: TRAILING_COMMA.sub(r"\1", t)):
        for t in list(tried):
            new = make(t)
            if new and new not in tried:
                tried.append(new)
    return tried


def repair(text: str | None) -> str | None:
    """The first candidate that parses to an object, as JSON text.  NaN and
    Infinity, which JSON does not have, count as null."""
    if not text or not text.strip():
        return None
    for t in candidates(text):
        try:
            found = json.loads(t, parse_constant=lambda _: None)
        except ValueError:
            continue
        if isinstance(found, dict):
            return json.dumps(found, ensure_ascii=False)
    return None


@F.pandas_udf(StringType())
def _repair(s: pd.Series) -> pd.Series:
    return s.map(repair)


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def parsed(df: DataFrame, text: str, out: str) -> DataFrame:
    """`df` with `out`, the object in column `text` as VARIANT, or null."""
    fast = F.try_parse_json(F.trim(F.col(text)))
    slow = F.try_parse_json(_repair(F.when(~is_object(fast), F.col(text))))
    return df.withColumn(out, F.when(is_object(fast), fast).otherwise(slow))


def envelope(v: Column) -> Column:
    """struct(value, legible, confidence, raw_transcription, note) with defaults:
    not legible, confidence 0, texts of whatever was given."""
    def part(name):
        return F.try_variant_get(v, f"$.{name}", "variant")

    def text(name):
        return F.when(~F.is_variant_null(part(name)), F.try_variant_get(v, f"$.{name}", "string"))

    legible, conf = part("legible"), part("confidence")
    kind = F.schema_of_variant(legible)
    truth = (
        F.when(kind == "BOOLEAN", F.try_variant_get(v, "$.legible", "boolean"))
        .when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(v, "$.legible", "double") != 0)
        .when(kind == "STRING", F.length(F.try_variant_get(v, "$.legible", "string")) > 0)
        .when(kind == "VOID", F.lit(False))
        .otherwise(~F.to_json(legible).isin("[]", "{}"))
    )
    number = F.schema_of_variant(conf)
    sure = F.when(number == "BOOLEAN", F.try_variant_get(v, "$.confidence", "boolean").cast("double")).when(
        number.isin("BIGINT", "DOUBLE") | number.startswith("DECIMAL"), F.try_variant_get(v, "$.confidence", "double")
    )
    return F.struct(
        part("value").alias("value"),
        F.coalesce(truth, F.lit(False)).alias("legible"),
        F.coalesce(sure, F.lit(0.0)).alias("confidence"),
        text("raw_transcription").alias("raw_transcription"),
        text("note").alias("note"),
    )
