"""Connected components by alternating large-star and small-star over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm._shared import settle, unsettle

#: A node is hot with more than this share of the edges, and not below this number of them.
HOT, LEAST = 1000, 500


def connected_components(edges: DataFrame, name: str = "components", most_rounds: int = 100) -> DataFrame:
    """(node, component): for each node of ``edges(a, b)`` the smallest node it can reach.

    Each round hangs every larger neighbour of a node on the smallest one (large-star),
    then every smaller neighbour (small-star), and writes the edges to the shared folder.
    Nodes that hold more than a HOT-th of all edges, of which there are at most 2 * HOT,
    are broadcast, so the neighbours of a star's centre need not meet in one task.
    Only a count and a hash sum of the edges reach the driver. Edges with a null end are
    ignored; loops and repeated edges do no harm; no edges give no rows.
    """
    ends = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e = settle(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    seen = _state(e)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        least = max(LEAST, 1 << (seen[0] // HOT).bit_length())  # a power of two, so that rounds share their compiled code
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("lo"), F.count("*").alias("n")).select("u", F.least("lo", "u").alias("lo"), (F.col("n") > least).alias("hot"))
        centre = F.broadcast(low.where("hot").select("u", F.col("lo").alias("centre")))
        out = both.where("v > u").join(centre, "u", "left")
        rest = out.where("centre IS NULL").join(low, "u").select(F.col("v").alias("u"), F.col("lo").alias("v"))
        large = out.where("centre IS NOT NULL").select(F.col("v").alias("u"), F.col("centre").alias("v")).unionByName(rest)
        nearest = large.groupBy("u").agg(F.min("v").alias("lo"))
        small = large.join(nearest, "u").where("v <> lo").select(F.col("v").alias("u"), F.col("lo").alias("v"))
        before, e = e, settle(small.unionByName(nearest.select("u", F.col("lo").alias("v"))).distinct(), name)
        unsettle(before)
        now = _state(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"{name}: no end after {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
