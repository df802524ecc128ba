"""Exact nearest neighbours within a key, in any number of dimensions, without pairing a key's rows with each other.

Pool rows lie in the cells of a grid over their first ``axes`` dimensions, whose cells are as wide as makes them hold
about ``FILL`` rows of their key. A query meets the rows of the cells around its own. Rows outside a ring of r cells are
at least r cell widths away in one dimension, so once the k-th best found is nearer than that, nothing outside can be
better. A query that found fewer than k rows looks twice as far; one that found k knows how far it has to look at most,
and that is the last time. Of pool rows with equal vectors only the k least ids can be among the k nearest. Queries of
equal vectors are one query: each leaves its own row out of what that one found.

Queries stand once for each cell that they look into, which the planner doesn't count, so no side of that join is sent
to the driver to be broadcast; and a pair farther than the k-th that a query has found is left out before pairs are
sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandway.functions.vectors import squared_distance, stepped
from strandway.operators.selection import top_k
from strandway.sources.stages import kept, released

#: Rows of a cell, and the relative room for the rounding of cells and distances.
FILL, SLACK = 16, 1e-9


def nearest(queries: DataFrame, pool: DataFrame, key: str, query_id: str, pool_id: str, vector: str, k: int, axes: int = 2, own: bool = False, digits: int | None = None) -> DataFrame:
    """key, query_id, pool_id, distance, rank, compared: the ``k`` pool rows of its key nearest to each query, by the
    Euclidean distance of ``vector`` (an array of doubles), equal ones by pool_id.

    Query ids differ within a key. A query without a pool has no row; with fewer than k rows in its key it has all of them. Rows with a null key or
    vector, or with a null or non-finite component, take no part. With ``own``, a pool row whose id is the query's is
    left out. With ``digits``, distances are rounded (``vectors.stepped``) before they are ranked. ``compared`` says with
    how many rows the query was compared the last time, its own included.
    """
    take = k + 1 if own else k
    fine = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    p = top_k(pool.where(fine).select(key, pool_id, F.col(vector).cast("array<double>").alias("_p")), [key, "_p"], [F.col(pool_id)], take).drop("rank")
    p = kept(p, "pool")
    at = lambda v, i: F.coalesce(F.get(F.col(v), F.lit(i)), F.lit(0.0))
    facts = p.groupBy(key).agg(F.count("*").alias("_n"), *[f(at("_p", i)).alias(f"_{n}{i}") for i in range(axes) for f, n in ((F.min, "low"), (F.max, "high"))])
    per_axis = F.greatest(F.floor(F.pow(F.col("_n") / FILL, F.lit(1.0 / axes))), F.lit(1))
    for i in range(axes):
        facts = facts.withColumn(f"_w{i}", (F.col(f"_high{i}") - F.col(f"_low{i}")) / per_axis)
    grid = kept(facts.select(key, "_n", per_axis.cast("long").alias("_m"), *[c for i in range(axes) for c in (f"_low{i}", f"_w{i}")]), "grid")
    # the last cell takes what lies on the upper edge; an axis without extent is one cell
    cell = lambda v, i: F.when(F.col(f"_w{i}") > 0, F.floor((at(v, i) - F.col(f"_low{i}")) / F.col(f"_w{i}"))).otherwise(F.lit(0)).cast("long")
    last = F.col("_m") - 1
    placed = p.join(grid, key).select(key, pool_id, "_p", *[F.least(cell("_p", i), last).alias(f"_c{i}") for i in range(axes)])
    placed = kept(placed, "placed")

    asked = kept(queries.where(fine).select(key, query_id, F.col(vector).cast("array<double>").alias("_q")), "asked")
    # -0.0 and 0.0 are equal to a group and alike to every distance
    distinct = asked.groupBy(key, "_q").agg(F.min(query_id).alias(query_id))
    q = distinct.join(grid, key)
    # an axis with extent bounds the distance of what lies beyond a ring; the edge of the query's own cell counts nothing
    width = F.array_min(F.array(*[F.when(F.col(f"_w{i}") > 0, F.col(f"_w{i}")).otherwise(F.lit(float("inf"))) for i in range(axes)]))
    for i in range(axes):
        q = q.withColumn(f"_a{i}", cell("_q", i))
    outside = F.greatest(F.lit(0), *[x for i in range(axes) for x in (-F.col(f"_a{i}"), F.col(f"_a{i}") - last)])
    open_ = kept(q.select(key, query_id, "_q", "_n", "_m", width.alias("_w"), *[f"_a{i}" for i in range(axes)], outside.alias("_r"), F.lit(False).alias("_sure"), F.lit(None).cast("double").alias("_bound")), "open")
    room = 0.0 if digits is None else 10.0**-digits  # what rounding can hide
    raw = F.sqrt(squared_distance(F.col("_q"), F.col("_p")))
    distance = raw if digits is None else stepped(raw, digits)
    done = None
    while not open_.isEmpty():
        near = open_
        for i in range(axes):
            reach = F.sequence(F.greatest(F.col(f"_a{i}") - F.col("_r"), F.lit(0)), F.least(F.col(f"_a{i}") + F.col("_r"), last))
            near = near.withColumn(f"_c{i}", F.explode(F.when(F.greatest(F.col(f"_a{i}") - F.col("_r"), F.lit(0)) <= F.least(F.col(f"_a{i}") + F.col("_r"), last), reach)))
        pairs = near.join(placed.hint("merge"), [key, *[f"_c{i}" for i in range(axes)]]).select(key, query_id, pool_id, "_bound", distance.alias("distance"))
        best = top_k(pairs.where("_bound IS NULL OR distance <= _bound").drop("_bound"), [key, query_id], [F.col("distance"), F.col(pool_id)], take)
        counts = pairs.groupBy(key, query_id).agg(F.count("*").alias("compared"))
        found = kept(best.join(counts, [key, query_id]), "found")
        reached = found.groupBy(key, query_id).agg(F.count("*").alias("_k"), F.max("distance").alias("_d"))
        state = open_.join(reached, [key, query_id], "left").fillna(0, ["_k"])
        every = F.greatest(*[x for i in range(axes) for x in (F.col(f"_a{i}"), last - F.col(f"_a{i}"))]) <= F.col("_r")
        sure = F.col("_sure") | every | ((F.col("_k") >= take) & (F.col("_d") + room < F.col("_r") * F.col("_w") * (1 - SLACK)))
        state = kept(state.withColumn("_end", F.coalesce(sure, F.lit(False))), "state")
        ended = found.join(state.where("_end").select(key, query_id), [key, query_id])
        done = ended if done is None else done.unionByName(ended)
        enough = F.col("_k") >= take
        further = F.when(enough, F.least(F.floor((F.col("_d") + room) / F.col("_w") * (1 + SLACK)) + 1, F.col("_m") + F.col("_r"))).otherwise(F.greatest(2 * F.col("_r"), F.lit(1)))
        before, open_ = open_, kept(state.where("NOT _end").select(*[c for c in open_.columns if c not in ("_r", "_sure", "_bound")], further.cast("long").alias("_r"), enough.alias("_sure"), F.when(enough, F.col("_d")).alias("_bound")), "open")
        released(before)
    if done is None:
        done = placed.limit(0).select(key, F.lit(None).cast(queries.schema[query_id].dataType).alias(query_id), pool_id, F.lit(0.0).alias("distance"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("compared"))
    # what the one query found goes to all of its vector
    same = asked.join(distinct.withColumnRenamed(query_id, "_first"), [key, "_q"]).select(key, query_id, "_first")
    each = same.join(done.withColumnRenamed(query_id, "_first"), [key, "_first"]).drop("_first")
    if own:
        each = each.where(~F.col(query_id).eqNullSafe(F.col(pool_id)))
        each = top_k(each.drop("rank"), [key, query_id], [F.col("distance"), F.col(pool_id)], k)
    return each.select(key, query_id, pool_id, "distance", "rank", "compared")
