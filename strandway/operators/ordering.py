"""Places of rows in ordered sequences of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandway.sources.stages import kept


def same(a: DataFrame, b: DataFrame, columns: list[str]):
    """The condition that two tables agree in ``columns``, null with null; an equi-join to the planner."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & a[c].eqNullSafe(b[c])
    return cond


def numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """pos (from 0) and n, the place of a row in its key's sequence and its length.

    One range sort spreads even a single key over all tasks, then counts by task and key give the offsets; a window
    would sort each key in one task. ``order`` has to be total within a key. Null keys are a key. The result is read
    from a table in the shared folder.
    """
    tasks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = df.repartitionByRange(tasks, *keys, *order).sortWithinPartitions(*keys, *order)
    ranged = kept(ranged.select("*", F.spark_partition_id().alias("_part"), at.alias("_at")), "ranged")
    counts = ranged.groupBy("_part", *keys).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    w = W.partitionBy(*keys)  # a row for each task that holds some of the key
    shift = F.sum("_rows").over(w.orderBy("_part")) - F.col("_rows") - F.col("_first")
    starts = kept(counts.select("_part", *keys, shift.alias("_shift"), F.sum("_rows").over(w).alias("n")), "starts")
    joined = ranged.join(starts, same(ranged, starts, ["_part", *keys]))
    return joined.select(*[ranged[c] for c in df.columns], (ranged["_at"] + starts["_shift"]).alias("pos"), starts["n"])

