"""From model replies to extraction rows.

Replies are a table (page_id, field_name, role, text, latency_ms): the model is
an outside function.  A first reply that cannot be parsed falls back on the
retry; values are coerced and scored by type; second readings can flag; rules
come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import score
from ..functions.coerce import coerce, json_text
from ..functions.compare import values_match
from ..functions.jsonrepair import envelope, is_object, parsed
from ..functions.text import held, let, quoted
from ..schema import FieldDef


def parsed_replies(replies: DataFrame) -> DataFrame:
    """(page_id, field_name, env, latency_ms) of primary replies, or of retries
    where the primary does not parse; env is null if neither does."""
    rows = parsed(replies.where(F.col("role").isin("primary", "retry")), "text", "v").withColumn("v", F.when(is_object(F.col("v")), F.col("v")))
    first, again = rows.where("role = 'primary'"), rows.where("role = 'retry'")
    again = again.select("page_id", "field_name", F.col("v").alias("_v"), F.col("latency_ms").alias("_ms"))
    both = first.join(again, ["page_id", "field_name"], "left")
    used = F.col("v").isNull()
    return both.select(
        "page_id", "field_name", F.coalesce("v", "_v").alias("env"), (F.col("latency_ms") + F.when(used, F.coalesce("_ms", F.lit(0))).otherwise(0)).alias("latency_ms")
    )


def by_field(fields, make, name: str = "field_name") -> Column:
    """make(field) of the row's field; null for other names."""
    out = F.lit(None)
    for fd in fields:
        out = F.when(F.col(name) == fd.name, make(fd)).otherwise(out)
    return out


def stored_value(text: Column, fd: FieldDef) -> Column:
    """A stored JSON text as the field's type."""
    return coerce(F.try_parse_json(text), fd)["value"]


def read_fields(replies: DataFrame, fields, threshold: float) -> DataFrame:
    """Extraction rows of the replies to any of `fields`.

    Replies are parsed once, whatever the number of fields; each row is then
    coerced as its field's type asks, and kept as JSON text.
    """
    rows = parsed_replies(replies.where(F.col("field_name").isin([f.name for f in fields])))
    rows = rows.withColumn("e", held(envelope(F.col("env"))))

    def one(fd):
        def read(c):
            return F.struct(
                json_text(c["value"]).alias("value"),
                c["error"].alias("error"),
                c["value"].isNotNull().alias("given"),
                score.agreement(c["value"], F.col("e.raw_transcription"), fd).alias("agree"),
                F.lit(fd.required).alias("required"),
                F.lit(float(fd.threshold(threshold))).alias("limit"),
            )

        return let(coerce(F.col("e.value"), fd), read)

    rows = rows.withColumn("c", held(by_field(fields, one)))
    c = lambda n: F.col(f"c.{n}")
    rows = rows.withColumn("o", held(score.outcome_of(c("given"), c("error").isNull(), c("agree"), F.col("e.legible"), F.col("e.confidence"), c("required"), c("limit"))))
    bad = F.col("env").isNull()
    keep = lambda x: F.when(~bad, x)
    errors = F.when(bad, F.array(F.lit(score.UNPARSED_ERROR))).otherwise(F.array_compact(F.array("c.error")))
    return rows.select(
        "page_id", "field_name",
        F.when(bad, F.lit("null")).otherwise(c("value")).alias("value"),
        keep(F.col("e.raw_transcription")).alias("raw_transcription"),
        keep(F.col("e.legible")).alias("legible"),
        keep(F.col("e.note")).alias("note"),
        keep(F.col("e.confidence")).alias("model_confidence"),
        F.when(bad, 0.0).otherwise(F.col("o.composite")).alias("composite"),
        F.when(bad, "unparsed").otherwise(F.col("o.status")).alias("validation_status"),
        errors.alias("validation_errors"),
        (bad | F.col("o.flagged")).alias("flagged"),
        F.when(bad, F.lit(score.UNPARSED)).otherwise(F.col("o.flag_reason")).alias("flag_reason"),
        F.bround("latency_ms").cast("int").alias("latency_ms"),
    )


def values_agree(fields, value: str, other: str) -> Column:
    """Whether two columns of stored JSON texts hold equal values of the row's
    field."""

    def same(fd):
        return let(F.struct(stored_value(F.col(value), fd).alias("a"), stored_value(F.col(other), fd).alias("b")), lambda x: values_match(x["a"], x["b"], fd, composed=True))

    return F.coalesce(by_field(fields, same), F.lit(False))


def verified(first: DataFrame, second: DataFrame, match: Column, primary_is_crop: Column) -> DataFrame:
    """`first` readings checked against `second` ones (page_id, field_name,
    value, raw_transcription).  Only accepted, non-null values are checked; a
    disagreement flags, halves the composite and is noted.  `match` compares
    value and verify_value."""
    again = second.select("page_id", "field_name", F.col("value").alias("verify_value"), F.col("raw_transcription").alias("_raw"), F.lit(True).alias("_read"))
    rows = first.join(again, ["page_id", "field_name"], "left")
    given = F.col("value").isNotNull() & (F.col("value").cast("string") != "null")
    off = ~F.col("flagged") & given & F.coalesce(F.col("_read"), F.lit(False)) & ~F.coalesce(match, F.lit(False))
    where = F.when(primary_is_crop, "whole page").otherwise("crop")
    reason = F.concat(F.lit("verify pass disagreement: second read from the "), where, F.lit(" gave "), F.substring(F.coalesce(F.col("verify_value").cast("string"), F.lit("null")), 1, 120))
    read = F.concat(F.lit("verify read: "), F.coalesce(quoted(F.col("_raw")), F.lit("None")))
    note = F.when(F.coalesce(F.length("note"), F.lit(0)) > 0, F.concat(F.col("note"), F.lit(" | "), read)).otherwise(read)
    return (
        rows.withColumn("_off", off)
        .withColumn("flag_reason", F.when(F.col("_off"), reason).otherwise(F.col("flag_reason")))
        .withColumn("composite", F.when(F.col("_off"), F.col("composite") * score.VERIFY_FACTOR).otherwise(F.col("composite")))
        .withColumn("note", F.when(F.col("_off"), note).otherwise(F.col("note")))
        .withColumn("flagged", F.col("flagged") | F.col("_off"))
        .drop("_off", "_raw", "_read", "verify_value")
    )


def crop_routed(field_type: Column, crop_types: list[str], has_crop: Column) -> Column:
    """Whether the field is read from its crop: all types if none are named."""
    return has_crop & (F.lit(True) if not crop_types else field_type.isin(*crop_types))
