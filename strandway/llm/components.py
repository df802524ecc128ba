"""Connected components of an undirected graph, with aggregates and joins only.

Alternating large-star and small-star rounds: each node's neighbours are linked to the least id that the node knows.
No neighbour list is ever built; a hub's edges are spread by the join, and its least neighbour comes from a partial
aggregate. The rounds needed grow with the logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandway.llm.scratch import clear


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One half round on edges u > v. Large: the larger neighbours of u go to the least node u knows, itself included.
    Small: u and its smaller neighbours do."""
    near = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("m", "w").alias("m"))
    joined = near.join(least, F.col("u") == F.col("w"))
    if not small:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def _unfinished(edges: DataFrame) -> bool:
    """Whether any node has two edges down, or edges both up and down."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = ends.groupBy("n").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
    return not nodes.where("down > 1 OR (down > 0 AND up > 0)").isEmpty()


def components(edges: DataFrame, stage: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """node, component: the least id reachable, for every node that has an edge to another node.

    ``edges`` has two id columns; null ids and loops don't count, repeats don't matter. ``stage`` writes a table to
    the shared folder and reads it back, once a half round. No edges give no rows.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    now = stage(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while _unfinished(now):
        large = stage(_star(now, small=False), "large")
        small = stage(_star(large, small=True), "small")
        clear(now, large)
        now = small
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
