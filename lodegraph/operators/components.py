"""Connected components of a graph given as links, without ever gathering links outside their executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.session import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links (u, v), u > v. Large: every neighbour above a node is linked to the least of its
    neighbourhood; small: every node's lesser neighbours and the node itself are. The least is a pre-aggregated
    minimum, so a hub costs one partial result per task; the join back has one row per node on its other side."""
    if large:
        ends = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        ends = links
    least = ends.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = ends.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of a link to another node; component is the smallest node of the component.

    Large-star and small-star steps in turn, until the links form stars: O(log^2 n) rounds whatever the shape (chains,
    circles, hubs). Each round is written to the checkpoint folder. Null ends and self-links are dropped; a node
    without other links has no row. Raises if the rounds do not suffice, so no partial result can come out.
    """
    e = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = cut(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    fingerprint = None
    for _ in range(max_rounds):
        e = cut(_star(_star(e, large=True), large=False))
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == fingerprint:
            tops = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
        fingerprint = (now["n"], now["h"])
    raise RuntimeError(f"components have not settled in {max_rounds} rounds")
