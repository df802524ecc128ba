"""Ranking, thinning, splitting and set checks with deterministic ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_order(seed: str, key: Column) -> Column:
    """The sort key of a seeded order: hex sha256 of 'seed:key'."""
    return F.sha2(F.concat_ws(":", F.lit(seed), key.cast("string")), 256)


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def diverse_top(df: DataFrame, group: list[str], family: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in order, at most one of each family."""
    return top_k(top_k(df, [*group, family], order, 1).drop("rank"), group, order, k)


def tail_split(df: DataFrame, keys: list[str], order: list[str], share: int) -> DataFrame:
    """split: the last ceil(n / share) rows of each sequence are 'test'."""
    w = W.partitionBy(*keys)
    row, n = F.row_number().over(w.orderBy(*order)), F.count("*").over(w)
    return df.withColumn("split", F.when(row > n - F.ceil(n / share), "test").otherwise("train"))


def held_out(df: DataFrame, key: str, seed: str, count: int) -> DataFrame:
    """key, held_out: the ``count`` keys that come first in the seeded order. Keys are groups, not rows."""
    keys = df.select(key).distinct().withColumn("h", hash_order(seed, F.col(key)))
    first = keys.orderBy("h", key).limit(count).select(key, F.lit(True).alias("held_out"))
    return keys.drop("h").join(first, key, "left").fillna(False, ["held_out"])


def evenly_spaced(df: DataFrame, group: list[str], order: list[str], count: int) -> DataFrame:
    """Rows at the distinct rounded linspace places of each group, the middle one for a count of one."""
    w = W.partitionBy(*group)
    d = df.withColumns({"_r": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    at = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.rint(i * (F.col("_n") - 1) / (count - 1)).cast("long")) if count > 1 else F.array(F.rint((F.col("_n") - 1) / 2).cast("long"))
    return d.where(F.array_contains(at, F.col("_r").cast("long"))).drop("_r", "_n")


def seeded_sample(df: DataFrame, group: list[str], key: str, seed: str, count: int) -> DataFrame:
    """``count`` rows of each group without replacement: those that come first in the seeded order."""
    return top_k(df, group, [hash_order(seed, F.col(key)), F.col(key)], count)


def first_per_split(df: DataFrame, split: list[str], order: list, n: int) -> DataFrame:
    """At most ``n`` rows of each split, in order (an allowlist's top, an episode cap, a head)."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*split).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def allowed(df: DataFrame, ranking: DataFrame, split: list[str], key: str, rank: str, k: int) -> DataFrame:
    """Rows whose key is among the first ``k`` of its split's ranking."""
    return df.join(first_per_split(ranking, split, [rank, key], k).select(*split, key).distinct(), [*split, key], "left_semi")


def promoted(demos: DataFrame, rollouts: DataFrame, success: Column) -> DataFrame:
    """The demos and, as demos too, the successful rollouts."""
    return demos.unionByName(rollouts.where(success))


def anchor_first(df: DataFrame, group: list[str], anchor: Column, tie: Column, k: int) -> DataFrame:
    """rank: anchors first, then by the tie's order; the first ``k`` of each group."""
    w = W.partitionBy(*group).orderBy(F.when(anchor, 0).otherwise(1), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nested_pools(df: DataFrame, rank: str, sizes: list[int]) -> DataFrame:
    """pool: each row once for every pool size that reaches its rank."""
    return df.withColumn("pool", F.explode(F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: F.col(rank) <= s)))


def thinned(df: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """The rows of a group at the distinct whole parts of ``size`` evenly spaced places from first to last; all rows of
    a smaller group."""
    w = W.partitionBy(*group)
    placed = df.withColumns({"_p": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    # place p is taken where i * (n - 1) / (size - 1) falls in [p, p + 1) for a whole i below size
    last = F.greatest(F.col("_n") - 1, F.lit(1))
    i = F.ceil(F.col("_p") * (size - 1) / last)
    hit = F.floor(i * last / (size - 1)) == F.col("_p")
    return placed.where((F.col("_n") <= size) | ((i < size) & hit)).drop("_p", "_n")


def longest_prefix(df: DataFrame, path: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """match: the longest of the prefixes that a path starts with, null without any. Paths are cut at each "/", so the
    join is an equi-join, and a path's own prefixes are all that it meets."""
    parts = F.split(path, "/")
    cuts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    known = prefixes.select(F.col(prefix).alias("_x")).distinct()
    rows = df.withColumn("_id", F.struct(*df.columns))
    hits = rows.select("_id", F.explode(cuts).alias("_x")).join(known, "_x").groupBy("_id").agg(F.max_by("_x", F.length("_x")).alias("match"))
    return rows.join(hits, "_id", "left").drop("_id")


def disagreement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """only_a, only_b, shared and repeated: how two key sets differ, and the repeats within them."""
    both = a.select(F.col(key), F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(F.col(key), F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    n = both.groupBy(key).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    return n.agg(
        F.count_if((F.col("_a") > 0) & (F.col("_b") == 0)).alias("only_a"), F.count_if((F.col("_a") == 0) & (F.col("_b") > 0)).alias("only_b"),
        F.count_if((F.col("_a") > 0) & (F.col("_b") > 0)).alias("shared"), F.count_if((F.col("_a") > 1) | (F.col("_b") > 1)).alias("repeated"),
    )


def cycled(df: DataFrame, order: list[str], group: list[str], length: int) -> DataFrame:
    """slot: the rows of each group repeated in order until there are ``length``; of a longer group the first."""
    w = W.partitionBy(*group)
    placed = df.withColumns({"_p": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)}).where(F.col("_p") < length)
    times = F.sequence(F.col("_p").cast("long"), F.lit(length - 1).cast("long"), F.col("_n").cast("long"))
    return placed.withColumn("slot", F.explode(times)).drop("_p", "_n")


def in_range(x: Column, low: float, high: float) -> Column:
    """Whether a rate lies between two bounds, both included."""
    return x.between(low, high)
