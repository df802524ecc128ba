"""Evaluation of predictions: window metrics, roll-ups to units, paired comparisons, gates and trends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandway.functions import rotations as rot
from strandway.functions.vectors import norm


def outside(place: Column, low: Column, high: Column) -> Column:
    """Whether a component of a place lies below low or above high (arrays of as many components)."""
    return F.exists(F.zip_with(F.zip_with(place, low, lambda x, a: x < a), F.zip_with(place, high, lambda x, b: x > b), lambda a, b: a | b), lambda x: x)


def valid_rotation(six: Column, tolerance: float = 2e-4) -> Column:
    """Whether both halves of a 6-D rotation have length one and stand upright on each other."""
    from strandway.functions.vectors import dot

    a, b = F.slice(six, 1, 3), F.slice(six, 4, 3)
    return (F.abs(norm(a) - 1) <= tolerance) & (F.abs(norm(b) - 1) <= tolerance) & (F.abs(dot(a, b)) <= tolerance)


def residual(target: Column, plan: Column) -> Column:
    return F.zip_with(target, plan, lambda t, p: t.cast("double") - p.cast("double"))


def reconstructed(difference: Column, plan: Column) -> Column:
    return F.zip_with(difference, plan, lambda d, p: d + p.cast("double"))


def mean_prediction(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """mean: the mean vector of each key's predictions, component by component; the last one clipped to [0, 1]."""
    each = df.select(*keys, F.posexplode(vector).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    lists = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_v"))  # as long as a vector
    values = F.transform("_v", lambda v: v["_m"])
    clip = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.element_at(values, -1)))
    return lists.select(*keys, F.concat(F.slice(values, 1, F.size(values) - 1), F.array(clip)).alias("mean"))


def projected_mean(df: DataFrame, keys: list[str], rank: str, vector: str) -> DataFrame:
    """pose and fell_back: the mean of each key's predictions of ten numbers, its rotation made a proper one again, as a
    mean of rotations is none. Where nothing is left of it, that of the prediction of the least ``rank`` stands in."""
    first = df.groupBy(*keys).agg(F.min_by(vector, rank).alias("_first"))
    both = mean_prediction(df, keys, vector).join(first, keys)
    return both.select(*keys, rot.projected(F.col("mean"), F.col("_first")).alias("_p")).select(*keys, "_p.pose", "_p.fell_back")


def pose_errors(predicted: Column, target: Column) -> dict[str, Column]:
    """position, orientation (radians), gripper and canonical (all ten numbers) error of poses of ten numbers."""
    diff = F.zip_with(predicted, target, lambda a, b: a.cast("double") - b.cast("double"))
    turn = lambda v: rot.matrix_of_6d(F.slice(v, 4, 6))
    return {"position": norm(F.slice(diff, 1, 3)), "orientation": rot.geodesic(turn(predicted), turn(target)), "gripper": F.abs(F.element_at(diff, 10)), "canonical": norm(diff)}


def pose_window_metrics(steps: DataFrame, keys: list[str], step: str, predicted: str, target: str) -> DataFrame:
    """position_, orientation_, gripper_ and canonical_median of each window's steps, and final_position and
    final_orientation, those of its last step. A window is a few rows, so medians are plain."""
    d = steps.select(*keys, F.col(step).alias("_k"), *[e.alias(f"_{n}") for n, e in pose_errors(F.col(predicted), F.col(target)).items()])
    medians = [F.median(f"_{n}").alias(f"{n}_median") for n in ("position", "orientation", "gripper", "canonical")]
    return d.groupBy(*keys).agg(*medians, F.max_by("_position", "_k").alias("final_position"), F.max_by("_orientation", "_k").alias("final_orientation"))


def window_metrics(steps: DataFrame, keys: list[str], step: str, predicted: str, target: str, places: int = 3) -> DataFrame:
    """position_median, gripper_median, final_position and canonical_median of each key's steps. A vector begins with
    ``places`` numbers of a place and ends with the gripper."""
    diff = F.zip_with(predicted, target, lambda a, b: a.cast("double") - b.cast("double"))
    d = steps.select(*keys, F.col(step).alias("_k"), diff.alias("_d"))
    d = d.select(*keys, "_k", norm(F.slice("_d", 1, places)).alias("_p"), F.abs(F.element_at("_d", -1)).alias("_g"), norm(F.col("_d")).alias("_c"))
    return d.groupBy(*keys).agg(F.median("_p").alias("position_median"), F.median("_g").alias("gripper_median"), F.max_by("_p", "_k").alias("final_position"), F.median("_c").alias("canonical_median"))


def unit_rollup(windows: DataFrame, unit: list[str], metrics: list[str], guards: list[str]) -> DataFrame:
    """window_count, the median of each metric and the sum of each guard, for each unit (task and seed)."""
    return windows.groupBy(*unit).agg(F.count("*").alias("window_count"), *[F.median(m).alias(m) for m in metrics], *[F.sum(g).cast("long").alias(g) for g in guards])


def paired_units(treatment: DataFrame, baseline: DataFrame, unit: list[str], metric: str) -> DataFrame:
    """status (paired, only_treatment, only_baseline) and difference (treatment less baseline) of every unit."""
    a = treatment.select(*unit, F.col(metric).alias("_a"), F.lit(True).alias("_in_a"))
    b = baseline.select(*unit, F.col(metric).alias("_b"), F.lit(True).alias("_in_b"))
    status = F.when(F.col("_in_a").isNull(), "only_baseline").when(F.col("_in_b").isNull(), "only_treatment").otherwise("paired")
    return a.join(b, unit, "full_outer").select(*unit, status.alias("status"), (F.col("_a") - F.col("_b")).alias("difference"))


def paired_summary(paired: DataFrame, task: str) -> DataFrame:
    """unit_count, effect_median, effect_q25, effect_q75, improved_tasks (tasks of a median under 0): one row, over
    units, which are few."""
    own = paired.where("status = 'paired'").withColumn("_t", F.median("difference").over(W.partitionBy(task)))
    return own.agg(
        F.count("*").alias("unit_count"),
        F.median("difference").alias("effect_median"),
        F.percentile("difference", F.lit(0.25)).alias("effect_q25"),
        F.percentile("difference", F.lit(0.75)).alias("effect_q75"),
        F.count_distinct(F.when(F.col("_t") < 0, F.col(task))).alias("improved_tasks"),
    )


def gate(df: DataFrame, **conditions: Column) -> DataFrame:
    """Each condition as a boolean column, null as false, and passed, their conjunction."""
    each = {k: F.coalesce(v, F.lit(False)) for k, v in conditions.items()}
    return df.withColumns(each).withColumn("passed", reduce(lambda a, b: a & b, [F.col(k) for k in each]))


def adjacent_worsening(df: DataFrame, keys: list[str], order: str, metric: str) -> DataFrame:
    """worsened: how often the metric rises from one value of ``order`` to the next."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumn("_up", F.col(metric) > F.lag(metric).over(w)).groupBy(*keys).agg(F.count_if("_up").alias("worsened"))


def comparison(reference: DataFrame, candidate: DataFrame, query: str, keys: list[str], metric: str) -> DataFrame:
    """Means, relative change and counts of improved, unchanged and worsened queries; lower is better, and a majority is
    over half of them."""
    both = reference.select(query, *keys, F.col(metric).alias("_r")).join(candidate.select(query, *keys, F.col(metric).alias("_c")), [query, *keys])
    d = F.col("_c") - F.col("_r")
    out = both.groupBy(*keys).agg(
        F.count("*").alias("queries"), F.avg("_r").alias("reference_mean"), F.avg("_c").alias("candidate_mean"), F.count_if(d < 0).alias("improved"), F.count_if(d == 0).alias("unchanged"), F.count_if(d > 0).alias("worsened")
    )
    change = F.when(F.col("reference_mean") != 0, (F.col("candidate_mean") - F.col("reference_mean")) / F.col("reference_mean"))
    return out.withColumns({"relative_change": change, "majority": F.col("improved") >= F.floor(F.col("queries") / 2) + 1})


def trend(df: DataFrame, keys: list[str], iteration: str, metric: str) -> DataFrame:
    """best_iteration (the first of the least metric), latest against first, best and previous, and a label."""
    w = W.partitionBy(*keys).orderBy(iteration)
    d = df.withColumns({"_before": F.lag(metric).over(w)}).withColumn("_falls", F.coalesce(F.col(metric) <= F.col("_before"), F.lit(True)))
    pick = lambda f, c: f(c, iteration)
    out = d.groupBy(*keys).agg(
        F.min_by(iteration, F.struct(F.col(metric), F.col(iteration))).alias("best_iteration"),
        pick(F.max_by, metric).alias("latest"),
        pick(F.min_by, metric).alias("first"),
        F.min(metric).alias("best"),
        pick(F.max_by, "_before").alias("previous"),
        F.every("_falls").alias("monotone"),
    )
    change = lambda c: F.when(F.col(c) != 0, (F.col("latest") - F.col(c)) / F.col(c))
    out = out.withColumns({"against_first": change("first"), "against_best": change("best"), "against_previous": change("previous")})
    label = F.when(F.col("monotone"), "improving").when(F.col("latest") <= F.col("first"), "mixed").otherwise("worse")
    return out.withColumn("label", label)


def content_hash(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """sha256: of the hashes of a key's rows in order. A row's hash covers the listed columns as text, null apart from
    empty; the list that is sorted holds 64 characters a row."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]), 256)
    lists = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, row.alias("_h")))).alias("_l"))
    return lists.select(*keys, F.sha2(F.array_join(F.transform("_l", lambda x: x["_h"]), ""), 256).alias("sha256"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all items of two sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(1.0)


def ridge(df: DataFrame, features: list[str], target: str, alpha: float) -> DataFrame:
    """term and weight of a ridge regression on standardised features with an unpenalised bias. The normal equations
    come from one aggregate; only their (features + 1) squared sums reach the driver."""
    import numpy as np

    rows = df.dropna(subset=[*features, target])
    stats = rows.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{i}") for i, c in enumerate(features) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scale = [stats[f"s_{i}"] if stats[f"s_{i}"] and stats[f"s_{i}"] > 1e-12 else 1.0 for i in range(len(features))]
    z = [(F.col(c) - stats[f"m_{i}"]) / scale[i] for i, c in enumerate(features)] + [F.lit(1.0)]
    size = len(z)
    sums = rows.agg(*[F.sum(z[i] * z[j]).alias(f"g{i}_{j}") for i in range(size) for j in range(i, size)], *[F.sum(z[i] * F.col(target)).alias(f"b{i}") for i in range(size)]).first()
    gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)], float)
    gram[np.arange(size - 1), np.arange(size - 1)] += alpha
    weights = np.linalg.solve(gram, np.array([sums[f"b{i}"] for i in range(size)], float))
    return df.sparkSession.createDataFrame([(t, float(w)) for t, w in zip([*features, "bias"], weights, strict=True)], "term string, weight double")
