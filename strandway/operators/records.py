"""Filters and checks of records: suites, flags, schema versions, rule tables, requested rows, guardrails."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandway.operators.selection import top_k


def suites_of_prefix(df: DataFrame, suite: str, prefixes: dict[str, int], order: list[str]) -> DataFrame:
    """``df`` with prefix: rows whose suite is 'prefix_number', so that rot15 doesn't take rot150. The first rows in
    ``order`` up to a prefix's number are taken, all of them where it is 0 or less."""
    each = F.array(*[F.when(F.col(suite).rlike(f"^{re.escape(p)}_[0-9]+$"), F.lit(p)) for p in prefixes])
    rows = df.withColumn("prefix", F.explode(F.filter(each, lambda p: p.isNotNull())))
    capped = {p: n for p, n in prefixes.items() if n > 0}
    parts = [rows.where(~F.col("prefix").isin(*capped))] if capped else [rows]
    for p, n in capped.items():
        parts.append(rows.where(F.col("prefix") == p).orderBy(*order).limit(n))
    return reduce(DataFrame.unionByName, parts)


def not_skipped(df: DataFrame, flags: list[str]) -> DataFrame:
    """Rows none of whose flags is 1; a missing flag is none."""
    return df.where(reduce(lambda a, b: a & b, [F.coalesce(F.col(f), F.lit(0)) != 1 for f in flags]))


def of_metadata(df: DataFrame, text: str, path: str, wanted: bool | None) -> DataFrame:
    """Rows whose JSON has ``wanted`` at ``path``; all rows where ``wanted`` is None. A missing value is in neither."""
    if wanted is None:
        return df
    return df.where(F.get_json_object(text, path).try_cast("boolean") == wanted)


def with_results(df: DataFrame, results: dict[str, Column]) -> DataFrame:
    """``df`` with the results as columns, without rows where one of them is null."""
    return df.withColumns(results).dropna(subset=list(results))


def without_extensions(df: DataFrame) -> DataFrame:
    """Columns named 'key.extension' become 'key'. Two columns of one key raise a ValueError."""
    names = [c.rsplit(".", 1)[0] if "." in c else c for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("two columns of one key")
    return df.toDF(*names)


def merged_record(df: DataFrame, record: str, names: dict[str, str]) -> DataFrame:
    """Fields of a struct as columns under new names, without the struct. They replace columns of the same names."""
    return df.withColumns({new: F.col(record)[old] for old, new in names.items()}).drop(record)


def of_version(df: DataFrame, version: Column, wanted: str) -> DataFrame:
    """``df``; a row of another schema version, or of none, fails the query when it is read."""
    ok = version.eqNullSafe(F.lit(wanted))
    return df.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("schema version "), F.coalesce(version.cast("string"), F.lit("none")))).cast("boolean")))


def rows_requested(requests: DataFrame, rows: DataFrame, request: str, wanted: str, key: str, payload: str) -> DataFrame:
    """request and values: the payloads of the rows that an array of keys names, in its order and with its repeats,
    each row read once. A key without a row gives a null."""
    each = requests.select(request, F.posexplode(wanted).alias("_i", key))
    read = rows.join(each.select(key).distinct(), key, "left_semi").select(key, F.col(payload).alias("_v"))
    placed = each.join(read, key, "left").groupBy(request).agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_p"))
    return placed.select(request, F.transform("_p", lambda x: x["_v"]).alias("values"))


def bound_to_split(frames: DataFrame, split: DataFrame, path: str) -> DataFrame:
    """``frames`` with the columns of their split record, and in_split, false where there is none."""
    return frames.join(split.withColumn("in_split", F.lit(True)), path, "left").withColumn("in_split", F.coalesce("in_split", F.lit(False)))


def episode_facts(df: DataFrame, key: str, widths: dict[str, int], whole: list[str]) -> DataFrame:
    """key, frame_count and violations (names): vectors of another width, numbers that aren't finite or, of ``whole``,
    not integer-valued, and episodes of under two rows. Nulls violate too."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    rules = {f"{c}_width": F.coalesce(F.size(c) == n, F.lit(False)) for c, n in widths.items()}
    rules |= {f"{c}_finite": F.coalesce(F.forall(c, lambda x: finite(x.cast("double"))), F.lit(False)) for c in widths}
    rules |= {f"{c}_integer": finite(F.col(c).cast("double")) & (F.rint(F.col(c).cast("double")) == F.col(c).cast("double")) for c in whole}
    sums = df.groupBy(key).agg(F.count("*").alias("frame_count"), *[F.count_if(~ok).alias(f"_{n}") for n, ok in rules.items()])
    broken = [F.when(F.col(f"_{n}") > 0, F.lit(n)) for n in rules] + [F.when(F.col("frame_count") < 2, F.lit("too_short"))]
    return sums.select(key, "frame_count", F.filter(F.array(*broken), lambda n: n.isNotNull()).alias("violations"))


def dataset_facts(episodes: DataFrame, task: str, path: str, split: DataFrame, least_episodes: int, least_tasks: int) -> DataFrame:
    """One row: episodes, tasks, unlisted and absent (episodes that aren't in the split, and the reverse), and valid:
    enough of the first two, none of the last two, and no violations."""
    listed = split.select(path).distinct().withColumn("_l", F.lit(1))
    both = episodes.select(path, task, "violations", F.lit(1).alias("_e")).join(listed, path, "full_outer")
    facts = both.agg(
        F.count("_e").alias("episodes"),
        F.count_distinct(task).alias("tasks"),
        F.count_if(F.col("_l").isNull()).alias("unlisted"),
        F.count_if(F.col("_e").isNull()).alias("absent"),
        F.count_if(F.size("violations") > 0).alias("invalid"),
    )
    return facts.withColumn("valid", (F.col("episodes") >= least_episodes) & (F.col("tasks") >= least_tasks) & (F.col("unlisted") + F.col("absent") + F.col("invalid") == 0))


def allowlisted(df: DataFrame, key: str, columns: list[str], segment: str, least: int) -> DataFrame:
    """The allowed columns of episodes that have a segment of at least ``least`` rows."""
    long = df.groupBy(key, segment).count().where(F.col("count") >= least).select(key).distinct()
    return df.select(*dict.fromkeys([key, *columns])).join(long, key, "left_semi")


def failed_guards(df: DataFrame, unit: list[str], guards: str) -> DataFrame:
    """unit, guard, value: the entries of a map of guardrails that are null or not zero. No rows: the gate is passed."""
    return df.select(*unit, F.explode(guards).alias("guard", "value")).where("value IS NULL OR CAST(value AS BIGINT) <> 0")


def zipped(streams: dict[str, DataFrame], index: str) -> DataFrame:
    """The rows of all streams with the same index side by side, as one struct a stream."""
    packed = [s.select(F.col(index), F.struct(*[c for c in s.columns if c != index]).alias(name)) for name, s in streams.items()]
    return reduce(lambda a, b: a.join(b, index), packed)


def annotated(df: DataFrame, key: str, order: list[str], annotation: str, tasks: DataFrame, index: str, text: str) -> DataFrame:
    """key and text of each row's annotation, by its index in the task table; a row without a task keeps a null."""
    return df.select(key, *order, F.col(annotation).alias(index)).join(tasks.select(index, text), index, "left").select(key, *order, text)


def gated_by_start(queries: DataFrame, starts: DataFrame, key: str, query_id: str, demo: str, distance: Column, gate: int) -> DataFrame:
    """The query's columns, demo and gate_distance of the ``gate`` demos of its key that start nearest to it."""
    pairs = queries.join(starts, key).withColumn("gate_distance", distance)
    return top_k(pairs, [query_id], [F.col("gate_distance"), F.col(demo)], gate).drop("rank")
