"""Connected components of a graph of links, by alternating large and small stars.

Each round joins the links with the smallest neighbour of every node, so hubs are split by the
engine's skew join, and writes the result as a table. The number of rounds grows with the logarithm
of the longest path, not with the size of a component; groups around a centre need one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sensorloom.session import materialise

MAX_ROUNDS = 60


def smallest(pairs: DataFrame) -> DataFrame:
    """(u, m): the smallest of a node and its partners."""
    return materialise(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))


def unfinished(edges: DataFrame) -> bool:
    """Some node has two partners below it, or a partner that has one itself."""
    several = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("one")).filter("n > 1").select("u")
    chained = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi")
    return not several.unionByName(chained).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in links (u, v); component is the smallest node of its group.

    ``links`` is read several times, so it should be a written table.
    """
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    for _ in range(MAX_ROUNDS):
        # Large star: partners above a node move to the smallest partner.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = smallest(both)
        large = both.filter("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialise(large)
        # Small star: a node and its partners below move to the smallest of them.
        near = smallest(large)
        edges = materialise(
            large.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(near.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        if not unfinished(edges):
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    # Now every edge leads to the smallest node of its component.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def joined_components(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links: only the components that these touch are worked on again."""
    if links.isEmpty():
        return groups
    name = lambda side: F.coalesce(F.col(f"{side}.component"), F.col(f"l.{side}"))
    between = materialise(
        links.alias("l").join(groups.alias("u"), F.col("l.u") == F.col("u.node"), "left")
        .join(groups.alias("v"), F.col("l.v") == F.col("v.node"), "left").select(name("u").alias("u"), name("v").alias("v")))
    wider = materialise(components(between))
    new = wider.join(groups.select("node"), "node", "left_anti").select("node", "component")
    return groups.join(wider.select(F.col("node").alias("component"), F.col("component").alias("_wider")), "component", "left").select(
        "node", F.coalesce("_wider", "component").alias("component")).unionByName(new)
