"""Checks of tables against each other and against a contract; each gives rows that say what differs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandway.operators.graphs import reached


def unequal_copies(source: DataFrame, copy: DataFrame, key: str, digest: str) -> DataFrame:
    """key and status (missing, extra, changed) of what a copy doesn't hold as the source does."""
    a, b = source.select(key, F.col(digest).alias("_a")), copy.select(key, F.col(digest).alias("_b"))
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status")).where("status IS NOT NULL")


def required(df: DataFrame, key: str, wanted: dict) -> DataFrame:
    """key, field, found: the fields of each row that don't have the required value (nulls included)."""
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("found"), F.col(c).eqNullSafe(F.lit(v)).alias("_ok")) for c, v in wanted.items()])
    return df.select(key, F.inline(F.filter(each, lambda x: ~x["_ok"]))).select(key, "field", "found")


def repeats(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """group, column, rows, distinct_values: whether a pool's members differ in every one of the columns."""
    long = df.select(group, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("_v")) for c in columns])).alias("_x")).select(group, "_x.*")
    return long.groupBy(group, "column").agg(F.count("*").alias("rows"), F.count_distinct("_v").alias("distinct_values"))


def leaked(statistics: DataFrame, rows: DataFrame, key: str, held_out: Column) -> DataFrame:
    """Keys that entered the statistics although they are held out."""
    return statistics.select(key).distinct().join(rows.where(held_out).select(key).distinct(), key, "left_semi")


def stable_hash(*columns: Column) -> Column:
    """sha256 of a row's JSON, keys in the order given, null fields left out."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def sorted_json_hash(columns: dict[str, Column]) -> Column:
    """sha256 of a row's JSON with its keys in order and nulls kept, so the order in which fields are given is no matter."""
    fields = [columns[k].alias(k) for k in sorted(columns)]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def failed_checks(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """key and check: the named conditions that a row doesn't meet; an unknown (null) one counts as not met."""
    each = F.array(*[F.struct(F.lit(name).alias("check"), F.coalesce(c, F.lit(False)).alias("_ok")) for name, c in checks.items()])
    return df.select(key, F.inline(F.filter(each, lambda x: ~x["_ok"]))).select(key, "check")


def frozen(artifacts: DataFrame, parents: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """id, own (unequal parents by hash), missing (parents that are gone), status and steps of every artifact.

    ``artifacts`` are id and sha256 as they are now; ``parents`` are id, parent and sha256, the parent's hash when the
    artifact was frozen. An artifact is ``broken`` where a parent has another hash or is gone, ``stale`` where that is
    so of one that it rests on, at the fewest ``steps`` away, and ``valid`` else. The fault is passed on edge by edge:
    a recursive query would count every path of a graph in which paths meet. Joins are merges: hashes are larger than
    their files let the planner think, and broadcasts would send them through the driver.
    """
    now = artifacts.select(F.col("id").alias("parent"), F.col("sha256").alias("_now"))
    held = parents.join(now.hint("merge"), "parent", "left")
    direct = held.groupBy("id").agg(F.count_if(F.col("_now").isNotNull() & ~F.col("_now").eqNullSafe(F.col("sha256"))).alias("own"), F.count_if(F.col("_now").isNull()).alias("missing"))
    facts = stage(artifacts.select("id").join(direct.hint("merge"), "id", "left").fillna(0, ["own", "missing"]))
    hit = reached(facts.where("own > 0 OR missing > 0").select("id"), stage(parents.select("parent", F.col("id").alias("child")).distinct()), stage)
    status = F.when((F.col("own") > 0) | (F.col("missing") > 0), "broken").when(F.col("steps").isNotNull(), "stale").otherwise("valid")
    return facts.join(hit.hint("merge"), "id", "left").withColumn("status", status)
