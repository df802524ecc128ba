"""Nearest-neighbour retrieval between queries and a pool of windows, with deterministic ties.

A pool row is found through places in sorted orders or through a thinned pool of bounded size, so no query meets all
rows of its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandway.functions.vectors import circular_degrees, stepped
from strandway.operators.selection import evenly_spaced, hash_order, top_k


def nearest_scalars(queries: DataFrame, pool: DataFrame, key: str, query_id: str, pool_id: str, at: str, k: int) -> DataFrame:
    """key, query_id, pool_id, distance, rank: the ``k`` pool rows nearest to each query in ``at``, ties to the lesser
    pool_id.

    The k nearest are among the last k pool rows below a query and the first k at or above it. Both sides are numbered
    within the key, each with its ties in id order, and joined by number: at most 2 * k rows for a query. Rows without
    a key or a place in ``at`` take no part; a query whose key has no pool gives no row.
    """
    q = queries.select(key, F.col(query_id).alias("_q"), F.col(at).alias("_at")).dropna(subset=[key, "_at"])
    p = pool.select(key, F.col(pool_id).alias("_p"), F.col(at).alias("_at")).dropna(subset=[key, "_at"])
    own = W.partitionBy(key)
    up, down = own.orderBy("_at", "_p"), own.orderBy("_at", F.desc("_p"))
    numbered = p.withColumns({"_up": F.row_number().over(up), "_down": F.row_number().over(down)})
    marks = q.select(key, "_q", "_at", F.lit(0).alias("_one")).unionByName(p.select(key, F.lit(None).cast(q.schema["_q"].dataType).alias("_q"), "_at", F.lit(1).alias("_one")))
    # a query sorts before pool rows of its own place, so the count is of those below it
    below = marks.withColumn("_below", F.sum("_one").over(own.orderBy("_at", "_one").rowsBetween(W.unboundedPreceding, 0))).where("_one = 0")
    wanted = below.select(key, "_q", F.col("_at").alias("_qat"), "_below", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("_i"))
    lower = wanted.withColumn("_n", F.col("_below") - F.col("_i") + 1).join(numbered.select(key, F.col("_down").cast("long").alias("_n"), "_p", "_at"), [key, "_n"])
    upper = wanted.withColumn("_n", F.col("_below") + F.col("_i")).join(numbered.select(key, F.col("_up").cast("long").alias("_n"), "_p", "_at"), [key, "_n"])
    found = lower.unionByName(upper).select(key, F.col("_q").alias(query_id), F.col("_p").alias(pool_id), F.abs(F.col("_at") - F.col("_qat")).alias("distance"))
    return top_k(found, [query_id], [F.col("distance"), F.col(pool_id)], k)


def thinned(pool: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """At most ``size`` evenly spaced pool rows of each key."""
    return evenly_spaced(pool, [key], order, size)


def rank_thinned(queries: DataFrame, pool: DataFrame, key: str, query_id: str, pool_id: str, distance: Column, seed: str, k: int) -> DataFrame:
    """The ``k`` rows of a thinned pool nearest to each query by any ``distance`` of both sides' columns, and how many
    there are (effective_k).

    Ties go by sha256 of 'seed:query:candidate', then by id. The pool is thinned beforehand, so the join has at most
    the pool's size of rows for a query.
    """
    pairs = queries.join(pool, key).withColumn("distance", distance)
    tie = hash_order(seed, F.concat_ws(":", F.col(query_id).cast("string"), F.col(pool_id).cast("string")))
    found = top_k(pairs, [query_id], [F.col("distance"), tie, F.col(pool_id)], k)
    return found.withColumn("effective_k", F.count("*").over(W.partitionBy(query_id)))


def rank_scalars(queries: DataFrame, pool: DataFrame, key: str, query_id: str, pool_id: str, at: str, digits: int, seed: str, k: int) -> DataFrame:
    """The ``k`` rows of the whole pool nearest to each query in ``at`` rounded to ``digits``, and how many there are
    (effective_k). Ties go by sha256 of 'seed:query:candidate', then by id.

    The rounded distance of the k-th nearest row comes from nearest_scalars. Only rows within it join the query: those
    tied at that distance all do, as nothing but their hashes tells which of them come first.
    """
    near = nearest_scalars(queries, pool, key, query_id, pool_id, at, k)
    reach = near.groupBy(query_id).agg(F.max(stepped(F.col("distance"), digits)).alias("_reach"))
    q = queries.select(key, query_id, F.col(at).alias("_qat")).join(reach, query_id).alias("q")
    p = pool.select(key, pool_id, F.col(at).alias("_at")).alias("p")
    distance = stepped(F.abs(F.col("_at") - F.col("_qat")), digits)
    pairs = q.join(p, (F.col(f"q.{key}") == F.col(f"p.{key}")) & (distance <= F.col("_reach"))).select(F.col(f"q.{key}"), query_id, pool_id, distance.alias("distance"))
    tie = hash_order(seed, F.concat_ws(":", F.col(query_id).cast("string"), F.col(pool_id).cast("string")))
    found = top_k(pairs, [query_id], [F.col("distance"), tie, F.col(pool_id)], k)
    return found.withColumn("effective_k", F.count("*").over(W.partitionBy(query_id)))


def padded(found: DataFrame, queries: DataFrame, query_id: str, pool_id: str, k: int) -> DataFrame:
    """query_id, rank, pool_id, masked: exactly ``k`` rows for each query; places without a match are masked."""
    places = queries.select(query_id).withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return places.join(found.select(query_id, "rank", pool_id), [query_id, "rank"], "left").withColumn("masked", F.col(pool_id).isNull())


def gated_nearest(pairs_gate: DataFrame, frames: DataFrame, query_id: str, demo: str, frame_id: str, distance: Column, gate: int) -> DataFrame:
    """The nearest frame of the ``gate`` demos whose gate_distance to the query is least; ties to the lesser id.

    ``pairs_gate`` has query_id, demo, gate_distance and the query's columns that ``distance`` uses.
    """
    near = top_k(pairs_gate, [query_id], [F.col("gate_distance"), F.col(demo)], gate).drop("rank")
    return top_k(near.join(frames, demo).withColumn("distance", distance), [query_id], [F.col("distance"), F.col(frame_id)], 1).drop("rank")


def predecessors(chunks: DataFrame, keys: list[str], at: str, step: int, payload: str) -> DataFrame:
    """before: ``payload`` of the row of the same keys whose ``at`` is ``step`` less; null where there is none."""
    earlier = chunks.select(*keys, (F.col(at) + step).alias(at), F.col(payload).alias("before"))
    return chunks.join(earlier, [*keys, at], "left")


def diverse_or_any(candidates: DataFrame, used: DataFrame, query_id: str, family: str, order: list[Column]) -> DataFrame:
    """The first candidate of each query whose family isn't used by it, or the first of all where every one is."""
    held = used.select(query_id, family).distinct().withColumn("_used", F.lit(True))
    marked = candidates.join(held, [query_id, family], "left").withColumn("fallback", F.coalesce("_used", F.lit(False))).drop("_used")
    return top_k(marked, [query_id], [F.col("fallback"), *order], 1).drop("rank")


def angular_pools(angles: DataFrame, pools: DataFrame, query_id: str, angle: str, pool_angle: str, k: int, exact: float = 0.5) -> DataFrame:
    """query_id, pool_angle, degrees, rank: the pool of the query's own angle alone where one is nearer than ``exact``
    degrees, else the ``k`` nearest by circular distance, ties to the lesser angle.

    Distinct angles of pools are a few directories: they travel as one row with an array, of checked size, and each
    query ranks them by itself, so nothing is shuffled.
    """
    known = pools.select(F.col(pool_angle).cast("double").alias("a")).distinct()
    if known.count() > 3600:
        raise ValueError("more than 3600 distinct pool angles")
    one = known.agg(F.sort_array(F.collect_list("a")).alias("_pools"))
    q = angles.select(query_id, F.col(angle).cast("double").alias("_a")).join(F.broadcast(one))
    each = F.array_sort(F.transform("_pools", lambda b: F.struct(circular_degrees(F.pmod(F.col("_a"), F.lit(360.0)), F.pmod(b, F.lit(360.0))).alias("degrees"), b.cast(pools.schema[pool_angle].dataType).alias(pool_angle))))
    near = q.select(query_id, F.slice(each, 1, k).alias("_n"))
    count = F.when(F.col("_n")[0]["degrees"] < exact, 1).otherwise(F.size("_n"))
    return near.select(query_id, F.posexplode(F.slice("_n", F.lit(1), count)).alias("_i", "_x")).select(query_id, "_x.*", (F.col("_i") + 1).alias("rank"))
