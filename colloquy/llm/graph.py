"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import settle


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) with root the smallest node of the component; edges are (u, v).

    Alternates large-star and small-star until nothing changes. Each round is
    joins and map-side combined minima over the edges, which never grow in
    number; it ends in a written table.
    """
    now = settle(
        edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    seen = None
    while True:
        # Every larger neighbour of a node moves to its smallest neighbour.
        both = _both_ways(now)
        large = (
            both.join(_least(both), "u")
            .filter("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        # Then every smaller neighbour of a node, and the node itself.
        down = settle(large.filter("u > v"), "large-star")
        least = _least(down)
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        now = settle(small.filter("u > v").distinct(), "small-star")
        total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if total == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = total
