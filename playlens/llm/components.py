"""Connected components by alternating stars, in DataFrame operations.

Every node is tied to the smallest node it knows of: first nodes hand their larger neighbours
to that minimum, then their smaller ones. The edges end as one star per component after a number
of rounds that grows with the logarithm of the size, however long the chains are. No round
gathers the neighbours of a node; hubs are joined, and AQE may split them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from playlens.llm.common import release, save


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of `edges` (a, b); component is the least node of it.

    Edges may repeat, point either way, or join a node to itself; an edge with a null end
    ties nothing and is left out. No edge gives no row.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL")
    both_ends = edges.select("a").unionByName(edges.select(F.col("b").alias("a"))).distinct()
    links = save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(),
        "links",
    )
    before, now = None, _state(links)
    while now != before:
        last, links = links, save(_small_star(_large_star(links)), "links")
        release(last)
        before, now = now, _state(links)
    stars = links.select(F.col("high").alias("a"), F.col("low").alias("component"))
    return both_ends.join(stars, "a", "left").select(
        F.col("a").alias("node"), F.coalesce("component", "a").alias("component")
    )


def _state(links: DataFrame) -> tuple:
    """What tells two sets of links apart: their number and two sums over their hashes."""
    parts = F.xxhash64("high", "low")
    return tuple(links.agg(
        F.count(F.lit(1)), F.sum(F.shiftrightunsigned(parts, 32)), F.sum(parts.bitwiseAND(F.lit(0xFFFFFFFF)))
    ).first())


def _large_star(links: DataFrame) -> DataFrame:
    ways = links.select(F.col("high").alias("n"), F.col("low").alias("m")).unionByName(
        links.select(F.col("low").alias("n"), F.col("high").alias("m"))
    )
    least = ways.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("least"))
    return ways.where("m > n").join(least, "n").select(F.col("m").alias("high"), F.col("least").alias("low")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    moved = links.join(least, "high").where("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.unionByName(least.select("high", F.col("least").alias("low"))).distinct()
