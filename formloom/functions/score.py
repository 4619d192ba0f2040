"""Confidence, agreement with what was written, and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DEFAULT_DATE_FORMAT, FieldDef
from .coerce import java_pattern
from .text import let, strip

#: Fixed values of the composite score.
AGREEMENT_FLOOR = 0.6
FAILED_FACTOR = 0.2
UNPARSED = "unparseable model output"
UNPARSED_ERROR = "model output was not parseable JSON after retry"
VERIFY_FACTOR = 0.5


def unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def composite(confidence: Column, passed: Column, agreement: Column) -> Column:
    scaled = unit(confidence) * (F.lit(AGREEMENT_FLOOR) + F.lit(1.0 - AGREEMENT_FLOOR) * unit(agreement))
    return unit(scaled * F.when(passed, 1.0).otherwise(FAILED_FACTOR))


def agreement(value: Column, raw: Column, fd: FieldDef) -> Column:
    """1.0 where the value shows in the raw text, or the type has no test."""
    written = strip(raw)
    runs = F.regexp_extract_all(written, F.lit(r"[0-9]+"), F.lit(0))
    if fd.type == "integer":
        found = F.array_contains(runs, value.cast("string"))
    elif fd.type == "float":
        numbers = F.regexp_extract_all(written, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
        found = F.exists(numbers, lambda n: F.abs(n.cast("double") - value) < 1e-9)
    elif fd.type == "date":
        day = F.try_to_timestamp(value, F.lit(java_pattern(fd.format or DEFAULT_DATE_FORMAT)))
        d, y = F.dayofmonth(day).cast("string"), F.year(day)
        found = F.coalesce(F.arrays_overlap(runs, F.array(d, F.lpad(d, 2, "0"), y.cast("string"), (y % 100).cast("string"))), F.lit(False))
    else:
        found = F.lit(True)
    return F.when(value.isNull(), 1.0).when(raw.isNull(), 0.5).otherwise(F.when(found, 1.0).otherwise(0.0))


def outcome_of(given: Column, passed: Column, agree: Column, legible: Column, confidence: Column, required: Column, limit: Column) -> Column:
    """struct(status, composite, flagged, flag_reason) of a reading: whether it
    gave a value, passed, agrees with what was written, and what its field asks."""

    def judged(score):
        low = given & (score < limit)
        # format_number rounds the number that is stored, ties to even.
        two = lambda x: F.format_number(x, 2)
        reasons = F.array_compact(
            F.array(
                F.when(~passed, "coercion/validation failed"),
                F.when(~legible, "model reports illegible"),
                F.when(~given & required, "required field is null"),
                F.when(low, F.concat(F.lit("composite confidence "), two(score), F.lit(" below threshold "), two(limit))),
            )
        )
        return let(
            reasons,
            lambda r: F.struct(
                F.when(passed, "pass").otherwise("fail").alias("status"),
                score.alias("composite"),
                (F.size(r) > 0).alias("flagged"),
                F.when(F.size(r) > 0, F.array_join(r, "; ")).alias("flag_reason"),
            ),
        )

    return let(composite(confidence, passed, agree), judged)


def outcome(value: Column, error: Column, legible: Column, confidence: Column, raw: Column, fd: FieldDef, default_threshold: float) -> Column:
    """struct(status, composite, flagged, flag_reason)."""
    limit = F.lit(float(fd.threshold(default_threshold)))
    return outcome_of(value.isNotNull(), error.isNull(), agreement(value, raw, fd), legible, confidence, F.lit(fd.required), limit)
