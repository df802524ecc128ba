"""Paired tests over a bounded set of evaluation units (task and seed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sign vectors are enumerated: 2^20 a family at most.
MOST_UNITS = 20


def sign_flip_p(df: DataFrame, family: list[str], unit: str, difference: str) -> DataFrame:
    """family and p: the share of all sign vectors whose mean of signed differences is at most the observed one.

    Exact and one-sided. A family of more than ``MOST_UNITS`` units is an error, as its vectors can't be enumerated.
    """
    n = F.count("*")
    sized = df.groupBy(*family).agg(F.when(n <= MOST_UNITS, n).otherwise(F.raise_error(F.lit(f"over {MOST_UNITS} units"))).alias("n"), F.array_sort(F.collect_list(F.struct(F.col(unit), F.col(difference).cast("double").alias("d")))).alias("u"))
    bits = sized.withColumn("bits", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2.0), F.col("n")).cast("long") - 1)))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("i"))
    signed = F.aggregate("u", zero, lambda a, x: F.struct((a["s"] + F.when(F.getbit(F.col("bits"), a["i"]) == 1, x["d"]).otherwise(-x["d"])).alias("s"), (a["i"] + 1).alias("i")))["s"]
    seen = F.aggregate("u", F.lit(0.0), lambda a, x: a + x["d"])
    return bits.groupBy(*family).agg(F.avg((signed / F.col("n") <= seen / F.col("n") + 1e-15).cast("int")).alias("p"))


def drawn(label: Column, count: Column) -> Column:
    """A number from 0 to count - 1 by the first 28 bits of the label's sha256."""
    return F.conv(F.substring(F.sha2(label, 256), 1, 7), 16, 10).cast("long") % count


def hierarchical_bootstrap(df: DataFrame, task: str, seed: str, difference: str, resamples: int, random_seed: str) -> DataFrame:
    """low and high: the 2.5 and 97.5 percentiles of the resampled medians.

    A resample draws as many tasks as there are, with replacement, and within each draw as many of its seeds. The
    draws are a hash of the random seed, the resample and the place, so they don't depend on partitions. The units of
    one evaluation (tasks times seeds) are bounded and travel as one row; resamples are dealt out over the cluster.
    """
    tasks = df.groupBy(task).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seed), F.col(difference).cast("double").alias("d")))), lambda x: x["d"]).alias("d"))
    units = tasks.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(task), F.col("d")))), lambda x: x["d"]).alias("u"))
    b = df.sparkSession.range(resamples).select(F.col("id").alias("b")).join(F.broadcast(units))
    places = b.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("u") - 1)))
    label = lambda *x: F.concat_ws(":", F.lit(random_seed), *[c.cast("string") for c in x])
    own = places.withColumn("t", F.get("u", drawn(label(F.col("b"), F.col("i")), F.size("u")).cast("int")))
    cells = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.size("t") - 1)))
    values = cells.select("b", F.get("t", drawn(label(F.col("b"), F.col("i"), F.col("j")), F.size("t")).cast("int")).alias("x"))
    return values.groupBy("b").agg(F.median("x").alias("m")).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
