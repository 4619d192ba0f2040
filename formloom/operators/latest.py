"""Newest row for each key.

Aggregation with map-side partials instead of a window: no key's rows are
gathered or sorted.  Ties need `order` columns that tell rows apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: list[str], order: list[str], keep: list[str] | None = None) -> DataFrame:
    """keys and `keep` (default: all others) of each key's greatest row by
    `order`; a null sorts before all values."""
    keep = keep if keep is not None else [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*keep), F.struct(*[F.col(c) for c in order])).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in keep])
