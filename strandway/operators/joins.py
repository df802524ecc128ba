"""Lookups, stream merges and leakage-safe candidate joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lookup(df: DataFrame, matches: DataFrame, keys: list[str], defaults: dict) -> DataFrame:
    """A left join with the columns of ``defaults``, which stand in where a key has no match."""
    return df.join(matches.select(*keys, *defaults), keys, "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def positional(streams: dict[str, DataFrame], group: str, order: str, value: str) -> DataFrame:
    """The streams' values side by side by their place in each group, as far as the shortest goes."""
    w = W.partitionBy(group).orderBy(order)
    placed = [s.select(group, F.row_number().over(w).alias("place"), F.col(value).alias(name)) for name, s in streams.items()]
    return reduce(lambda a, b: a.join(b, [group, "place"]), placed)


def keyed_merge(streams: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """key, one column a stream, and missing (names of the streams without the key): of a key's repeats within a
    stream the first value counts. Rows with no missing stream are the inner join. Streams meet in one aggregate by
    key; a key's rows are pre-aggregated before the shuffle."""
    rows = reduce(DataFrame.unionByName, [s.select(F.col(key), F.lit(name).alias("_s"), F.col(value).alias("_v")) for name, s in streams.items()])
    merged = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.min(F.when(F.col("_s") == n, F.struct(F.col("_v").alias("v")))).alias(n) for n in streams])
    missing = F.filter(F.array(*[F.when(F.col(n).isNull(), n) for n in streams]), lambda x: x.isNotNull())
    return merged.select(key, *[F.col(n)["v"].alias(n) for n in streams], missing.alias("missing"))


def ordered_merge(streams: dict[str, DataFrame], key: str, value: str, order: str) -> DataFrame:
    """``keyed_merge`` where of a key's repeats within a stream the first one in ``order`` counts, null or not, and a key
    is missing in a stream only where it has no row there."""
    rows = reduce(DataFrame.unionByName, [s.select(F.col(key), F.lit(name).alias("_s"), F.col(value).alias("_v"), F.col(order).alias("_o")) for name, s in streams.items()])
    first = lambda n: F.min_by(F.when(F.col("_s") == n, F.struct(F.col("_v").alias("v"))), F.when(F.col("_s") == n, F.col("_o")))
    merged = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*[first(n).alias(n) for n in streams])
    missing = F.filter(F.array(*[F.when(F.col(n).isNull(), n) for n in streams]), lambda x: x.isNotNull())
    return merged.select(key, *[F.col(n)["v"].alias(n) for n in streams], missing.alias("missing"))


def leakage_safe(queries: DataFrame, candidates: DataFrame, task: str, path: str) -> DataFrame:
    """query and candidate of one task, without candidates of the same path that are the query's own window or whose
    rows first .. last overlap the query's future rows future_first .. future_last. Windows have id, first, last,
    future_first and future_last. Pairs grow with the square of a task's windows; rank them with a nearest-rank operator
    where only the best are wanted, and use ``leakage_safe_totals`` where only their number and sum are."""
    c = candidates.select(task, F.col(path).alias("c_path"), F.col("id").alias("candidate"), F.col("first").alias("c_first"), F.col("future_last").alias("c_last"))
    q = queries.select(task, F.col(path).alias("q_path"), F.col("id").alias("query"), "future_first", "future_last")
    leaks = (F.col("c_path") == F.col("q_path")) & ((F.col("candidate") == F.col("query")) | ((F.col("c_first") <= F.col("future_last")) & (F.col("future_first") <= F.col("c_last"))))
    return q.join(c, task).where(~F.coalesce(leaks, F.lit(False))).select(task, "query", "candidate")


def leakage_safe_totals(queries: DataFrame, candidates: DataFrame, task: str, path: str) -> DataFrame:
    """task, query, candidates and ids: how many candidates ``leakage_safe`` pairs with each query that has any, and the
    sum of their ids, without the pairs.

    Of a task's totals those of the query's own path that leak are taken off. Windows that overlap the query's future
    are those that begin up to its last row less those that end before its first, both running sums along a path;
    windows of the query's id that don't overlap are joined by id. first <= future_last and future_first <=
    future_last hold in every window. Work grows with the windows, not with their pairs.
    """
    q = queries.select(task, F.col(path).alias("_path"), F.col("id").alias("query"), "future_first", "future_last").where(F.col(task).isNotNull())
    c = candidates.select(task, F.col(path).alias("_path"), F.col("id").alias("_id"), "first", F.col("future_last").alias("_last"))
    none = F.lit(None).cast(q.schema["query"].dataType)
    mark = lambda at, turn, kind: F.struct(F.col(at).cast("long").alias("at"), F.lit(turn).alias("turn"), F.lit(kind).alias("kind"))
    # at one row: queries ask what has ended, then windows begin and end, then queries ask what has begun
    asked = q.select(task, "_path", "query", none.alias("_id"), F.inline(F.array(mark("future_first", 0, "ended"), mark("future_last", 2, "begun"))))
    held = c.select(task, "_path", none.alias("query"), "_id", F.inline(F.array(mark("first", 1, "begin"), mark("_last", 1, "end"))))
    w = W.partitionBy(task, "_path").orderBy("at", "turn").rowsBetween(W.unboundedPreceding, 0)
    run = lambda kind, x: F.coalesce(F.sum(F.when(F.col("kind") == kind, x)).over(w), F.lit(0))
    one, ids = F.lit(1), F.coalesce(F.col("_id"), F.lit(0))
    sums = asked.unionByName(held).withColumns({"_b": run("begin", one), "_bs": run("begin", ids), "_e": run("end", one), "_es": run("end", ids)}).where("turn <> 1")
    begun = F.col("kind") == "begun"
    parts = sums.select(task, "query", begun.cast("long").alias("rows"), F.when(begun, -F.col("_b")).otherwise(F.col("_e")).alias("n"), F.when(begun, -F.col("_bs")).otherwise(F.col("_es")).alias("s"))
    overlap = (F.col("first") <= F.col("future_last")) & (F.col("future_first") <= F.col("_last"))
    alike = q.join(c.withColumn("query", F.col("_id")), [task, "_path", "query"]).where(~F.coalesce(overlap, F.lit(False)))
    parts = parts.unionByName(alike.select(task, "query", F.lit(0).cast("long").alias("rows"), F.lit(-1).cast("long").alias("n"), (-F.col("_id")).alias("s")))
    taken = parts.groupBy(task, "query").agg(*[F.sum(x).alias(x) for x in ("rows", "n", "s")])
    totals = c.groupBy(task).agg(F.count("*").alias("_n"), F.sum(ids).alias("_s"))
    safe = taken.join(totals, task).select(task, "query", (F.col("rows") * F.col("_n") + F.col("n")).alias("candidates"), (F.col("rows") * F.col("_s") + F.col("s")).alias("ids"))
    return safe.where("candidates > 0")


def caption_of_chunk(windows: Column, chunk: Column) -> Column:
    """The caption window of a chunk (from 0); one past the end means the last, anything further null."""
    at = F.when(chunk == F.size(windows), chunk - 1).otherwise(chunk)
    return F.when((at >= 0) & (at < F.size(windows)), F.get(windows, at.cast("int")))


def long_windows(windows: Column, fps: Column, least_seconds: float, least_frames: int) -> Column:
    """Caption windows without the last (if there are several) that last long enough and hold enough frames."""
    kept = F.slice(windows, F.lit(1), F.greatest(F.size(windows) - 1, F.lit(1)))
    frames = lambda w: w["stop"] - w["start"]
    return F.filter(kept, lambda w: (frames(w) >= least_seconds * fps) & (frames(w) >= least_frames))
