"""Connected components of a link table by alternating stars, as DataFrame rounds over shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamperlens.llm.common import stored

ROUNDS = 60


def _large(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link to another one.

    ``edges`` holds two long columns; nulls and self-links say nothing. Minima
    are combined before each shuffle and joins back onto a hub are left to
    adaptive skew handling. A round rewrites the links; it ends when a round
    changes nothing, then all links point at the smallest node.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    now = stored(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "links",
    )
    mark = None
    for _ in range(ROUNDS):
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not seen[0] or tuple(seen) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select("v", "v").distinct()
            )
        mark = tuple(seen)
        now = stored(_small(_large(now)), "links")
    raise RuntimeError("links did not settle")
