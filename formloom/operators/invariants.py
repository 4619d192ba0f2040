"""Checks that a store holds: each returns the rows that break one."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import as_string, is_null, kind
from ..schema import FieldDef, Schema
from .extract import by_field
from .store import in_scope, missing_fields


def uncovered(pages: DataFrame, field_defs: DataFrame, extractions: DataFrame) -> DataFrame:
    """Pages without a row for a field in scope."""
    return missing_fields(pages, field_defs, extractions).select("page_id", "field_name")


def wrongly_unflagged(extractions: DataFrame, must_flag: Column) -> DataFrame:
    return extractions.where(F.coalesce(must_flag, F.lit(False)) & ~F.col("flagged")).select("extraction_id")


def unreviewed_in_records(records: DataFrame, pages: DataFrame, extractions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Flagged extractions without review in documents that have a record."""
    rows = extractions.where("flagged").join(reviews.select("extraction_id"), "extraction_id", "left_anti")
    docs = rows.join(pages.select("page_id", "doc_id"), "page_id")
    return docs.join(records.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "extraction_id")


def open_provenance(records: DataFrame, extractions: DataFrame) -> DataFrame:
    """(record_id, field_name, problem): fields without provenance or the
    reverse, unknown extractions, flagged ones without a review."""
    values = records.select("record_id", F.explode(F.map_keys("final")).alias("field_name"), F.lit(True).alias("has_value"))
    sources = records.select("record_id", F.explode("provenance").alias("field_name", "p"))
    sources = sources.select("record_id", "field_name", F.col("p.extraction_id").alias("extraction_id"), F.col("p.review_id").alias("review_id"), F.lit(True).alias("has_source"))
    known = extractions.select("extraction_id", "flagged", F.lit(True).alias("known"))
    rows = values.join(sources, ["record_id", "field_name"], "full").join(known, "extraction_id", "left")
    problem = (
        F.when(F.col("has_value").isNull() | F.col("has_source").isNull(), "keys differ")
        .when(F.col("known").isNull(), "unknown extraction")
        .when(F.col("flagged") & F.col("review_id").isNull(), "flag without review")
    )
    return rows.select("record_id", "field_name", problem.alias("problem")).where("problem IS NOT NULL")


def cells_differ(exported: DataFrame, expected: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, column) cells of an export that differ from what they should be."""
    names = [c for c in expected.columns if c != key]
    long = lambda df: df.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")).alias("cell")) for n in names])).alias("x")).select(key, "x.*")
    a, b = long(exported).withColumnRenamed("cell", "got"), long(expected).withColumnRenamed("cell", "want")
    return a.join(b, [key, "column"], "full").where(~F.col("got").eqNullSafe(F.col("want"))).select(key, "column")


def gold_out_of_scope(gold: DataFrame, field_defs: DataFrame) -> DataFrame:
    """Gold rows whose field is not declared, or not for the page's type."""
    defs = F.broadcast(field_defs.select("field_name", "field_page_type", F.lit(True).alias("declared")))
    rows = gold.join(defs, "field_name", "left")
    return rows.where(F.col("declared").isNull() | (F.col("field_page_type").isNotNull() & F.col("page_type").isNotNull() & (F.col("field_page_type") != F.col("page_type")))).select("pair_id", "field_name")


def gold_uncovered(gold: DataFrame, pages: DataFrame, field_defs: DataFrame) -> DataFrame:
    """(page_id, field_name) in scope of a page with gold that have none."""
    have = gold.select("page_id", "field_name")
    return in_scope(pages.join(have.select("page_id").distinct(), "page_id", "left_semi"), field_defs).join(have, ["page_id", "field_name"], "left_anti").select("page_id", "field_name")


def gold_problem(v: Column, fd: FieldDef) -> Column:
    """What is wrong with a gold value (VARIANT), or null.  Gold is strict: a
    value must have its field's type as it stands, and be in its limits; a table
    must be a list of rows with exactly the declared columns."""
    k, text, number = kind(v), as_string(v), F.try_variant_get(v, "$", "double")
    out_of_range = F.lit(False)
    if fd.min is not None:
        out_of_range = out_of_range | (number < fd.min)
    if fd.max is not None:
        out_of_range = out_of_range | (number > fd.max)
    if fd.type == "table":
        rows = F.try_variant_get(v, "$", "array<map<string,variant>>")
        names = F.array_sort(F.array(*[F.lit(c.name) for c in fd.columns]))
        columns_differ = F.exists(rows, lambda r: F.array_sort(F.map_keys(r)) != names)
        limited = [c for c in fd.columns if c.type in ("integer", "float", "enum")]

        def bad_cell(r):
            found = [gold_problem(F.try_element_at(r, F.lit(c.name)), c).isNotNull() for c in limited]
            return reduce(or_, found, F.lit(False))

        cells = F.exists(rows, bad_cell)
        problem = (
            F.when((k != "list") | rows.isNull(), "not a list of rows")
            .when(F.size(rows) > fd.max_rows, "too many rows")
            .when(columns_differ, "columns differ")
            .when(cells, "cell out of range")
        )
        return F.when(is_null(v), "not a list of rows").otherwise(problem)
    if fd.type == "enum":
        problem = F.when((k != "str") | ~text.isin(*fd.values), "not a member")
    elif fd.type == "integer":
        problem = F.when(k != "int", "not an integer").when(out_of_range, "out of range")
    elif fd.type == "float":
        problem = F.when(~k.isin("int", "float"), "not a number").when(out_of_range, "out of range")
    elif fd.type in ("string", "free_text"):
        problem = F.when(k != "str", "not a text").when((F.length(text) > fd.max_length) if fd.max_length else F.lit(False), "too long")
    else:
        problem = F.lit(None).cast("string")
    return F.when(~is_null(v), problem)


def gold_problems(gold: DataFrame, schema: Schema, value: str = "gold_json") -> DataFrame:
    """Gold rows whose value breaks its field's constraints, with `problem`."""
    rows = gold.withColumn("_v", F.try_parse_json(value))
    return rows.withColumn("problem", by_field(schema.fields, lambda fd: gold_problem(F.col("_v"), fd)).cast("string")).drop("_v").where("problem IS NOT NULL")
