"""Equality of readings, by field type.

VARIANT has no equality, so values are compared as their types: texts in
comparison form, numbers within 1e-9, lists in order, rows by column.  Null
equals null only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FieldDef
from .text import comparison_form

CLOSE = 1e-9


def _both(got: Column, gold: Column, test: Column) -> Column:
    return F.when(got.isNull() | gold.isNull(), got.isNull() & gold.isNull()).otherwise(test)


def numbers_match(got: Column, gold: Column) -> Column:
    return _both(got, gold, F.abs(got.cast("double") - gold.cast("double")) < CLOSE)


def texts_match(got: Column, gold: Column, composed: bool = False) -> Column:
    return _both(got, gold, comparison_form(got, composed) == comparison_form(gold, composed))


def lists_match(got: Column, gold: Column, item) -> Column:
    pairs = F.zip_with(got, gold, item)
    return _both(got, gold, F.when(F.size(got) != F.size(gold), False).otherwise(F.forall(pairs, lambda ok: ok)))


def values_match(got: Column, gold: Column, fd: FieldDef, composed: bool = False) -> Column:
    """Equality of two coerced values of the field.  Lists and rows compare
    inside lambdas, where no UDF can run: their texts must be in compatibility
    form (`composed`)."""
    if fd.type in ("integer", "float"):
        return numbers_match(got, gold)
    if fd.type == "boolean":
        return _both(got, gold, got == gold)
    if fd.type == "checkbox_group":
        return lists_match(got, gold, lambda a, b: texts_match(a, b, True))
    if fd.type == "table":
        def rows(a, b):
            ok = F.lit(True)
            for c in fd.columns:
                ok = ok & values_match(a[c.name], b[c.name], c, True)
            return ok

        return lists_match(got, gold, rows)
    return texts_match(got, gold, composed)
