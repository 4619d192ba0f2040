"""Reviews: what a reviewer says, checked against the schema before it is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import coerce, json_text
from ..functions.text import held, let, quoted
from ..schema import Schema
from .extract import by_field

#: What a review can be.
ACTIONS = ("accept", "correct", "reject")


def checked(reviews: DataFrame, extractions: DataFrame, schema: Schema) -> DataFrame:
    """`reviews` (extraction_id, action, corrected_value as JSON text, ...) with
    field_name, the value to store, and `problem`, null for those to keep.

    A correction is coerced as its field's type asks; null corrects a field that
    is not required.  Other actions store no value.
    """
    rows = reviews.join(extractions.select("extraction_id", "field_name"), "extraction_id", "left")

    def one(fd):
        def read(c):
            empty = F.lit(f"{fd.name} is required: reject it to leave it empty")
            missing = c["error"].isNull() & c["value"].isNull() & F.lit(fd.required)
            return F.struct(json_text(c["value"]).alias("stored"), F.when(missing, empty).otherwise(c["error"]).alias("problem"))

        return let(coerce(F.try_parse_json(F.coalesce("corrected_value", F.lit("null"))), fd), read)

    rows = rows.withColumn("_c", held(by_field(schema.fields, one)))
    correct = F.col("action") == "correct"
    known = F.col("field_name").isin([f.name for f in schema.fields])
    problem: Column = (
        F.when(F.col("field_name").isNull(), "no such extraction")
        .when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), F.concat(F.lit("no such action: "), F.coalesce(quoted(F.col("action")), F.lit("None"))))
        .when(correct & ~known, F.concat(F.lit("not a field of the schema: "), F.col("field_name")))
        .when(correct & F.try_parse_json("corrected_value").isNull() & F.col("corrected_value").isNotNull(), "the correction is no JSON value")
        .when(correct, F.col("_c.problem"))
    )
    rows = rows.withColumn("problem", problem)
    return rows.withColumn("corrected_value", F.when(correct & F.col("problem").isNull(), F.col("_c.stored"))).drop("_c")


def accepted(rows: DataFrame, at: Column) -> DataFrame:
    """Rows of the reviews table of those without a problem."""
    key = F.substring(F.sha2(F.concat_ws(":", F.col("extraction_id").cast("string"), F.col("action"), F.coalesce(F.col("corrected_value"), F.lit("")), at.cast("string")), 256), 1, 16)
    return rows.where("problem IS NULL").drop("problem", "field_name").withColumn("review_id", key).withColumn("reviewed_at", at)
