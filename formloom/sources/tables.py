"""Readers of external sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def split_rows(df: DataFrame, column: str, out: str, separator: str = ",") -> DataFrame:
    """A row for each non-empty part of a separated list, stripped."""
    return df.withColumn(out, F.explode(F.split(column, separator))).withColumn(out, strip(F.col(out))).where(F.length(out) > 0)


def with_list_length(df: DataFrame, column: str, separator: str, length: int, first: int | None = None) -> DataFrame:
    """Rows whose separated list has `length` parts; `first` limits them."""
    rows = df.where(F.size(F.split(column, separator)) == length)
    return rows if first is None else rows.limit(first)
