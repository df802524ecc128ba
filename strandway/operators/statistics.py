"""Statistics, evaluation roll-ups and normalisation of vectors and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandway.operators.ordering import same
from strandway.operators.quantiles import exact_quantiles


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate over rows that have both; null where one of them doesn't vary. F.corr divides by the
    deviations before any condition around it holds, which ANSI mode refuses where all values are equal."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    a, b = F.stddev_pop(x), F.stddev_pop(y)
    return F.try_divide(F.covar_pop(x, y), F.when((a > 0) & (b > 0), a * b))


def dimension_statistics(df: DataFrame, vector: str) -> DataFrame:
    """dim and min, max, mean, std (population), median, q01, q99 of each component."""
    x = df.select(F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    moments = x.groupBy("dim").agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return moments.join(exact_quantiles(x, ["dim"], "x", {"median": 0.5, "q01": 0.01, "q99": 0.99}).drop("n"), "dim")


def histogram_with_zeros(df: DataFrame, column: str, buckets: list[str]) -> DataFrame:
    """status and rows for each declared bucket, those without rows included."""
    every = df.sparkSession.createDataFrame([(b,) for b in buckets], "status string")
    return every.join(df.groupBy(F.col(column).alias("status")).agg(F.count("*").alias("rows")), "status", "left").fillna(0, ["rows"])


def holm(df: DataFrame, p: str, family: list[str]) -> DataFrame:
    """p_holm: the step-down adjusted p-values within each family."""
    w = W.partitionBy(*family).orderBy(p)
    m = F.count("*").over(W.partitionBy(*family))
    scaled = F.col(p) * (m - F.row_number().over(w) + 1)
    return df.withColumn("_s", scaled).withColumn("p_holm", F.least(F.lit(1.0), F.max("_s").over(w.rowsBetween(W.unboundedPreceding, 0)))).drop("_s")


def best_and_worst(df: DataFrame, group: list[str], metric: str, tie: str, k: int) -> DataFrame:
    """side and rank of the k highest and k lowest rows of each group."""
    w = W.partitionBy(*group)
    ranked = df.withColumns({"hi": F.row_number().over(w.orderBy(F.desc(metric), tie)), "lo": F.row_number().over(w.orderBy(metric, tie))})
    sides = F.array(F.struct(F.lit("best").alias("side"), F.col("hi").alias("rank")), F.struct(F.lit("worst").alias("side"), F.col("lo").alias("rank")))
    return ranked.select("*", F.inline(F.filter(sides, lambda s: s["rank"] <= k))).drop("hi", "lo")


def lower_confidence(mean: Column, std: Column) -> Column:
    return mean - F.coalesce(std, F.lit(0.0))


def scaled(x: Column, low: Column, high: Column, mode: str) -> Column:
    """Min-max to [-1, 1] in the named dialect: plain, epsilon, clipped, constant_zero, equal_zero."""
    span = high - low
    raw = 2 * (x - low) / span - 1
    soft = 2 * (x - low) / (span + 1e-8) - 1
    return {
        "plain": F.when(span == 0, F.lit(None)).otherwise(raw),
        "epsilon": soft,
        "clipped": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), soft)),
        "constant_zero": F.when(span <= 1e-12, F.lit(0.0)).otherwise(raw),
        "equal_zero": F.when(low == high, F.lit(0.0)).otherwise(raw),
    }[mode]


def relative_change(now: Column, before: Column) -> Column:
    return F.when(before != 0, (now - before) / before)


def runtime_summary(df: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    """total, mean, median, least, most and p95 of each key's run times."""
    sums = df.groupBy(*keys).agg(F.sum(seconds).alias("total"), F.avg(seconds).alias("mean"), F.min(seconds).alias("least"), F.max(seconds).alias("most"))
    q = exact_quantiles(df, keys, seconds, {"median": 0.5, "p95": 0.95})
    return sums.join(q, same(sums, q, keys), "left").select(*[sums[c] for c in keys], "total", "mean", "median", "least", "most", "p95")


def nested_summary(df: DataFrame, sets: list[list[str]], value: str) -> DataFrame:
    """mean, median, min and max for each group of each set of keys; keys that a set leaves out are null."""
    every, out = list(dict.fromkeys(k for s in sets for k in s)), None
    for keys in sets:
        sums = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
        q = exact_quantiles(df, keys, value, {"median": 0.5})
        found = sums.join(q, same(sums, q, keys), "left")
        cells = [sums[k] if k in keys else F.lit(None).cast(df.schema[k].dataType).alias(k) for k in every]
        part = found.select(*cells, "mean", "median", "min", "max")
        out = part if out is None else out.unionByName(part)
    return out


def group_median(groups: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """n and m, the exact median, for every one of the groups; null for a group without rows."""
    return groups.join(exact_quantiles(rows, [key], value, {"m": 0.5}), key, "left").fillna(0, ["n"])


def vector_summary(df: DataFrame, vector: str, floor: float = 0.0) -> DataFrame:
    """dim, n, mean, std (population, at least ``floor``), low and high of each component."""
    x = df.select(F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return x.groupBy("dim").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.greatest(F.stddev_pop("x"), F.lit(floor)).alias("std"), F.min("x").alias("low"), F.max("x").alias("high"))


def role_statistics(frames: DataFrame, role: str, keys: list[str], order: list[str], value: str) -> DataFrame:
    """rows, mean, std, low, high, median, gaps, and step_p99 and step_max of steps that cross no gap, by role."""
    step = F.abs(F.col(value) - F.lag(value).over(W.partitionBy(*keys).orderBy(*order)))
    d = frames.withColumn("_step", F.when(~F.col("gap_mask"), step))
    return d.groupBy(role).agg(
        F.count("*").alias("rows"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"), F.median(value).alias("median"),
        F.percentile("_step", F.lit(0.99)).alias("step_p99"), F.max("_step").alias("step_max"), F.count_if("gap_mask").alias("gaps"),
    )


def delta_statistics(df: DataFrame, truth: str, plan: str) -> DataFrame:
    """dim, low and high of the difference of two vectors."""
    d = df.select(F.posexplode(F.zip_with(truth, plan, lambda a, b: a.cast("double") - b.cast("double"))).alias("dim", "x"))
    return d.groupBy("dim").agg(F.min("x").alias("low"), F.max("x").alias("high"))


def vector_mse(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """mse: the mean squared difference over all components of a key's pairs of vectors."""
    d = df.select(*keys, F.explode(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))).alias("_d"))
    return d.groupBy(*keys).agg(F.avg("_d").alias("mse"))


def ensemble(df: DataFrame, keys: list[str], value: str, threshold: float = 0.05) -> DataFrame:
    """average, lcb (average less one deviation), success_vote (share over the threshold) and majority_mean (the mean of
    those over it, 0 where they are under half), each within [0, 1]."""
    x = F.col(value).cast("double")
    won = F.avg((x > threshold).cast("int"))
    mean = F.coalesce(F.avg(F.when(x > threshold, x)), F.lit(0.0))
    each = {"average": F.avg(x), "lcb": lower_confidence(F.avg(x), F.stddev_samp(x)), "success_vote": won, "majority_mean": F.when(won >= 0.5, mean).otherwise(0.0)}
    return df.groupBy(*keys).agg(*[F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)).alias(k) for k, v in each.items()])
