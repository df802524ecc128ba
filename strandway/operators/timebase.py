"""Time base: gaps, segments, runs, strided and phase views, gap-safe windows and lag pairs of time-ordered rows.

Every operator partitions by the sequence's key, so one shuffle serves a chain of them. Frames are given as ``keys``
(the sequence) and ``order`` (its total order).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def gap_segments(df: DataFrame, keys: list[str], order: list[str], thresholds: dict[str, float]) -> DataFrame:
    """gap_mask and segment_id: a row opens a segment when a clock column runs back or leaps past its threshold.

    The first row of a key opens segment 0 without being a gap. Rows with a null clock never open one.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    deltas = {c: F.col(c) - F.lag(c).over(w) for c in thresholds}
    leaps = [(d < 0) | (d > F.lit(thresholds[c])) for c, d in deltas.items()]
    gap = F.coalesce(reduce(lambda a, b: a | b, leaps), F.lit(False))
    return df.withColumn("gap_mask", gap).withColumn("segment_id", F.sum(F.col("gap_mask").cast("int")).over(w))


def positions(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """pos (from 0) and n, the place in the sequence and its length."""
    w = W.partitionBy(*keys)
    return df.withColumn("pos", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n", F.count("*").over(w))


def contiguous_runs(df: DataFrame, keys: list[str]) -> DataFrame:
    """first_row, last_row and rows of each segment."""
    return df.groupBy(*keys, "segment_id").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.count("*").alias("rows"))


def strided_view(df: DataFrame, stride: int) -> DataFrame:
    """Every ``stride``-th row from the start of its segment."""
    return df.where(F.col("pos") % stride == 0)


def phase_bins(lengths: DataFrame, bins: int) -> DataFrame:
    """pos: the distinct rint(linspace(0, n - 1, min(n, bins))) of each sequence."""
    b = F.least(F.col("n"), F.lit(bins))
    step = F.when(b > 1, (F.col("n") - 1) / (b - 1)).otherwise(F.lit(0.0))
    at = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), b - 1), lambda i: F.rint(i * step).cast("long")))
    return lengths.withColumn("pos", F.explode(at))


def phase(df: DataFrame) -> DataFrame:
    return df.withColumn("phase", F.col("pos") / F.greatest(F.lit(1), F.col("n") - 1))


def history_future_windows(df: DataFrame, history: int, future: int, stride: int) -> DataFrame:
    """Current rows with ``history`` rows up to them and ``future`` rows after them, from row history - 1 on."""
    at = F.col("pos") - (history - 1)
    return df.where((at >= 0) & (at % stride == 0) & (F.col("pos") + future < F.col("n")))


def clamped_chunk(df: DataFrame, keys: list[str], order: list[str], value: str, length: int) -> DataFrame:
    """chunk: the values of rows pos .. pos + length - 1, the last one repeated past the end."""
    w = W.partitionBy(*keys).orderBy(*order)
    last = F.last(value).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    parts = [F.when(F.col("pos") + k < F.col("n"), F.lead(value, k).over(w)).otherwise(last) if k else F.col(value) for k in range(length)]
    return df.withColumn("chunk", F.array(*parts))


def spaced_history(df: DataFrame, keys: list[str], order: list[str], value: str, count: int, spacing: int) -> DataFrame:
    """history: the values at pos - k * spacing for k < count, the first one repeated before the start."""
    w = W.partitionBy(*keys).orderBy(*order)
    parts = [F.when(F.col("pos") >= k * spacing, F.lag(value, k * spacing).over(w)).otherwise(F.first(value).over(w)) if k else F.col(value) for k in range(count)]
    return df.withColumn("history", F.array(*parts))


def lag_pairs(df: DataFrame, keys: list[str], order: list[str], value: str, lag: int) -> DataFrame:
    """later: the value ``lag`` rows on, for rows whose segment still holds there."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"later": F.lead(value, lag).over(w), "_s": F.lead("segment_id", lag).over(w)}).where(F.col("_s") == F.col("segment_id")).drop("_s")


def long_runs(df: DataFrame, keys: list[str], order: list[str], flag: Column, least: int) -> DataFrame:
    """longest: the longest run of rows in which ``flag`` holds, and whether it has ``least`` rows."""
    w = W.partitionBy(*keys).orderBy(*order)
    islands = df.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_i", F.row_number().over(w) - F.row_number().over(W.partitionBy(*keys, "_f").orderBy(*order)))
    runs = islands.groupBy(*keys, "_i", "_f").agg(F.count_if("_f").alias("_k"))
    return runs.groupBy(*keys).agg(F.max("_k").alias("longest")).withColumn("detected", F.col("longest") >= least)


def nearest_match(left: DataFrame, right: DataFrame, key: str, at: str, tolerance: int, payload: str) -> DataFrame:
    """``payload`` and ``at`` of the nearest right row on either side, at most ``tolerance`` away, as match and
    match_at; of equal distances the earlier. One sort of both sides, no pairs."""
    both = left.withColumns({"_right": F.lit(False), "_p": F.lit(None).cast(right.schema[payload].dataType)}).unionByName(
        right.select(key, at, F.lit(True).alias("_right"), F.col(payload).alias("_p")), allowMissingColumns=True
    )
    w = W.partitionBy(key).orderBy(at, F.desc("_right"), "_p")
    back = W.partitionBy(key).orderBy(F.desc(at), F.desc("_right"), F.asc("_p"))
    mark = F.when(F.col("_right"), F.struct(F.col(at).alias("at"), F.col("_p").alias("p")))
    both = both.withColumns({"_b": F.last(mark, ignorenulls=True).over(w), "_a": F.last(mark, ignorenulls=True).over(back)}).where("NOT _right")
    before, after = F.col(at) - F.col("_b.at"), F.col("_a.at") - F.col(at)
    best = F.when(before.isNotNull() & (before <= F.coalesce(after, before)), F.col("_b")).otherwise(F.col("_a"))
    best = F.when(F.abs(best["at"] - F.col(at)) <= tolerance, best)
    return both.withColumns({"match": best["p"], "match_at": best["at"]}).drop("_right", "_p", "_a", "_b")
