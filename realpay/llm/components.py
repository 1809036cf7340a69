"""Connected components of a graph that is stored as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from realpay.llm.tables import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them. Needs u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node that has an edge; label: the least node of its component.

    ``edges`` has the long columns ``u, v``, in any direction, repeats allowed. Alternates large and small
    stars (Kiveris et al., "Connected components in MapReduce and beyond", 2014) until the edges, now one per
    node to its label, no longer change. A round only aggregates with ``min`` and joins, so a node of very
    many edges is combined before the shuffle and split by AQE in the join. Each round is stored.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    seen = None
    while True:
        sign = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        seen = sign
        now = stored(_small_star(_large_star(now)), "edges")
