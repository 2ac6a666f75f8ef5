"""Connected components by alternating stars, as joins over the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtura.runtime import materialise


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Per node u the least of u and its neighbours; combines before the shuffle, so a hub is no hot key."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where("v > u").join(_least_neighbour(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least_neighbour(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (two bigint columns ``u`` and ``v``); component is its least node.

    Edges are undirected, may repeat and may be loops (a node that has only a loop is its own component); rows with a
    NULL end are ignored. Each round is checkpointed to the shared folder; the number of rounds grows with the
    logarithm of the longest path. Only a count and a checksum reach the driver.
    """
    # Stored first: nodes and stars both start from the edges, which may be dear to find.
    whole = materialise(edges.where("u IS NOT NULL AND v IS NOT NULL").select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).distinct())
    nodes = whole.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    stars = whole.where("u <> v")
    before = None
    while True:
        stars = materialise(_small_star(_large_star(stars)).where("u <> v").distinct())
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return nodes.join(stars.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
