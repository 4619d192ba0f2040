"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, comp) of every node of `links` (a, b): equal comp, connected.

    Each round every node joins the neighbour that comes first in an order
    hashed anew for the round, so that the number of nodes that still have
    links falls by a constant factor whatever the graph's shape.  Aggregations
    have map-side partials; no neighbour list is gathered.  Lineage is cut by
    written tables.
    """
    links = stored(links.where("a <> b").select("a", "b").distinct(), "links")
    labels = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("comp", F.col("node"))
    labels = stored(labels, "labels")
    for k in range(max_rounds):
        if links.isEmpty():
            discard(links)
            return labels
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("r"), F.col(c).alias("id"))
        first = both.groupBy(F.col("a").alias("old")).agg(F.min(F.least(rank("a"), rank("b"))).alias("m"))
        first = stored(first.select("old", F.col("m.id").alias("new")), "first")
        a, b = first.select(F.col("old").alias("a"), F.col("new").alias("na")), first.select(F.col("old").alias("b"), F.col("new").alias("nb"))
        left = links.join(a, "a").join(b, "b").where("na <> nb")
        left = stored(left.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(), "links")
        named = labels.join(first.withColumnRenamed("old", "comp"), "comp", "left")
        named = stored(named.select("node", F.coalesce("new", "comp").alias("comp")), "labels")
        discard(links, labels, first)
        links, labels = left, named
    raise RuntimeError(f"links are left after {max_rounds} rounds")
