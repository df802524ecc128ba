"""Dependency graphs as tables of (parent, child): levels, closures, what is ready to run, and what a fault reaches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sound(nodes: DataFrame, edges: DataFrame) -> None:
    """A self-loop or an end that is no node raises a ValueError that names it."""
    loop = edges.where("parent = child").select("child").first()
    if loop is not None:
        raise ValueError(f"{loop[0]} depends on itself")
    ends = edges.select("parent", "child", F.explode(F.array("parent", "child")).alias("end"))
    unknown = ends.join(nodes.select(F.col("id").alias("end")), "end", "left_anti").first()
    if unknown is not None:
        raise ValueError(f"unknown node {unknown['end']} in {unknown['parent']} -> {unknown['child']}")


def levels(nodes: DataFrame, edges: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """id and level, the longest path from a node without parents; ordered by (level, id) the nodes are in topological
    order. Repeated edges count once.

    Nodes without open parents leave in rounds, one for each level; a round joins only the edges of those that left
    last. The round in which none leaves while nodes are left shows a cycle, which raises a ValueError, as do unknown
    nodes and self-loops. ``stage`` cuts the lineage.
    """
    edges = stage(edges.distinct())
    _sound(nodes, edges)
    degrees = nodes.select("id").distinct().join(edges.groupBy(F.col("child").alias("id")).agg(F.count("*").alias("left")), "id", "left").fillna(0, ["left"])
    waiting, done, level = stage(degrees), None, 0
    while True:
        free = stage(waiting.where("left = 0").select("id", F.lit(level).alias("level")))
        if free.isEmpty():
            break
        done = free if done is None else stage(done.unionByName(free))
        freed = edges.join(free, F.col("parent") == F.col("id")).groupBy(F.col("child").alias("id")).agg(F.count("*").alias("gone"))
        waiting = stage(waiting.where("left > 0").join(freed, "id", "left").select("id", (F.col("left") - F.coalesce("gone", F.lit(0))).alias("left")))
        level += 1
    if not waiting.isEmpty():
        raise ValueError(f"the graph has a cycle, which {waiting.first()['id']} is on or behind")
    return degrees.select("id", F.lit(0).alias("level")) if done is None else done


def reached(seeds: DataFrame, edges: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """id and steps: the seeds (id) and all that lies behind them, with the fewest edges on the way.

    A round goes one edge on from what was found last and leaves out what is known, so a node is found once whatever
    the number of paths to it, and cycles end. Joins are merges: broadcasts would send every round through the driver.
    """
    found = last = stage(seeds.select("id", F.lit(0).alias("steps")).distinct())
    while True:
        step = edges.join(last.hint("merge"), F.col("parent") == F.col("id")).select(F.col("child").alias("id"), (F.col("steps") + 1).alias("steps")).distinct()
        last = stage(step.join(found.select("id").hint("merge"), "id", "left_anti"))
        if last.isEmpty():
            return found
        found = stage(found.unionByName(last))


def closure(edges: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """ancestor and descendant of every path. Paths double in length each round.

    ``jump`` holds the paths of exactly 2^i edges, ``reach`` those of fewer; a round adds the jumps and the reaches that
    go on by a jump. So a pair is made once for each length of its paths, not once for each node between its ends. Pairs
    are dealt out by their ends before they are made distinct, as sums within a task would hold most of them.
    """
    pairs = ["ancestor", "descendant"]
    jump = stage(edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant")).distinct())
    reach, known = jump.limit(0), 0
    while True:
        tail = jump.select(F.col("ancestor").alias("_m"), "descendant").hint("merge")
        on = lambda head: head.select("ancestor", F.col("descendant").alias("_m")).join(tail, "_m").select(*pairs)  # noqa: B023, E731
        reach = stage(reach.unionByName(jump).unionByName(on(reach)).repartition(*pairs).distinct())
        count = reach.count()
        if count == known:
            return reach
        jump, known = stage(on(jump).repartition(*pairs).distinct()), count
        if jump.isEmpty():
            return reach


def ready(nodes: DataFrame, edges: DataFrame, done: DataFrame) -> DataFrame:
    """Nodes that aren't done and whose parents all are."""
    finished = done.select(F.col("id").alias("_d")).distinct()
    open_children = edges.join(finished, F.col("parent") == F.col("_d"), "left_anti").select(F.col("child").alias("id")).distinct()
    return nodes.join(finished, F.col("id") == F.col("_d"), "left_anti").join(open_children, "id", "left_anti").select("id")
