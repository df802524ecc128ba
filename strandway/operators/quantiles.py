"""Exact quantiles of any number of groups and columns, by histograms that close in on the ranks asked for.

Each round counts the values in at most about ``BINS`` bins of the range that still holds a rank, with the least and
largest value of a bin; the bin that holds the rank is the next range. The first round's bins are even parts of a
group's range, which costs little a value and mostly leaves few of them. Only those become whole numbers in the same
order (``bits.image``), whose range falls by that factor each round, so 64 bits take six more rounds at most, mostly one
or two, however uneven the values are. Counts are partial aggregates of narrow rows: no group's values ever meet in one
task, however large it is, and what is kept is a row a rank and a row a bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandway.functions import bits
from strandway.operators.ordering import same
from strandway.sources.stages import kept, released

BINS = 4096


def narrowed(data: DataFrame, by: list[str], left: DataFrame, ranges: DataFrame, at: Column) -> DataFrame:
    """``left`` (by, k, lo, hi, below) with the bin that holds each rank: its least and largest x, the rows before it.

    ``at`` is the bin of x in its range, of the columns of ``data`` and ``ranges``; it must not fall where x rises.
    """
    inside = data.join(ranges, same(data, ranges, by) & data["x"].between(ranges["lo"], ranges["hi"]))
    counted = inside.select(*[data[c] for c in by], ranges["lo"], "x", at.alias("bin")).groupBy(*by, "lo", "bin")
    w = W.partitionBy(*by, "lo").orderBy("bin")  # the bins of one range
    bins = counted.agg(F.count("*").alias("c"), F.min("x").alias("least"), F.max("x").alias("most")).withColumn("upto", F.sum("c").over(w))
    rank = left["k"] - left["below"]
    hit = left.join(bins, same(left, bins, [*by, "lo"]) & (rank < bins["upto"]) & (rank >= bins["upto"] - bins["c"]))
    return hit.select(*[left[c] for c in by], "k", bins["least"].alias("lo"), bins["most"].alias("hi"), (left["below"] + bins["upto"] - bins["c"]).alias("below"))


def near_ranks(data: DataFrame, by: list[str], ranks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The images of the x that share an even bin with a rank (by, x), and the ranks with the images of these bins' ends.

    Ranges that can't be divided evenly, with NaN or an infinite end or too near or far ends, stay as they are.
    """
    start = kept(ranks.select(*by, "k", "lo", "hi", F.lit(0).cast("long").alias("below")), "ranks")
    left = start.where("lo < hi")
    span, most = F.col("hi") - F.col("lo"), F.lit(float("inf"))
    scale = F.when((span < most) & (F.lit(float(BINS)) / span < most), F.lit(float(BINS)) / span)
    whole = kept(left.select(*by, "lo", "hi").distinct().withColumn("scale", scale), "ranges")
    at = F.coalesce(F.floor((data["x"] - whole["lo"]) * whole["scale"]), F.lit(0).cast("long"))
    found = kept(start.where("lo >= hi").unionByName(narrowed(data, by, left, whole, at)), "ranks")
    ranges = kept(found.where("lo < hi").select(*by, "lo", "hi").distinct(), "ranges")
    inside = data.join(ranges, same(data, ranges, by) & data["x"].between(ranges["lo"], ranges["hi"]))
    near = kept(inside.select(*[data[c] for c in by], bits.image(data["x"]).alias("x")), "near")
    ends = [bits.image(F.col(c)).alias(c) for c in ("lo", "hi")]
    images = kept(found.select(*by, "k", *ends, "below"), "ranks")
    released(start, whole, found, ranges)
    return near, images


def order_statistics(data: DataFrame, by: list[str], ranks: DataFrame) -> DataFrame:
    """The image of x of each row of ``ranks`` (by, k, lo, hi): the k-th least x, from 0, of ``data`` (by, x) in its group.

    lo and hi are the group's least and largest x. No x is null.
    """
    near, found = near_ranks(data, by, ranks)
    while not (left := found.where("lo < hi")).isEmpty():
        ranges = left.select(*by, "lo", "hi").distinct()
        ranges = kept(ranges.withColumn("width", F.expr(f"hi div {BINS} - lo div {BINS} + 1")), "ranges")
        nearer = narrowed(near, by, left, ranges, F.expr("x div width - lo div width"))
        before, found = found, kept(found.where("lo >= hi").unionByName(nearer), "ranks")
        released(before, ranges)
    released(near)
    return found.select(*by, "k", F.col("lo").alias("x"))


def exact_quantiles(df: DataFrame, by: list[str], value: str | Column, probs: dict[str, float], also: dict[str, Column] | None = None) -> DataFrame:
    """n, and a column for each name of ``probs``: that quantile of the group's values, linear between the two next.

    Null values don't count; a group without others has no row. NaN is larger than all numbers, null keys are a key.
    Without ``by`` there is one row, or none. ``also`` are aggregates of x, the values as doubles; they stand before the
    quantiles.
    """
    x, also = F.col(value) if isinstance(value, str) else value, also or {}
    data = kept(df.select(*by, x.cast("double").alias("x")).where("x IS NOT NULL"), "values")
    ends = [F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")]
    sizes = kept(data.groupBy(*by).agg(*ends, *[a.alias(name) for name, a in also.items()]).where("n > 0"), "sizes")
    place = {name: F.lit(float(p)) * (F.col("n") - 1) for name, p in probs.items()}
    sides = [f(p).cast("long") for p in place.values() for f in (F.floor, F.ceil)]
    ranks = sizes.select(*by, "lo", "hi", F.explode(F.array_distinct(F.array(*sides))).alias("k"))
    found = kept(order_statistics(data, by, ranks).withColumn("v", bits.value(F.col("x"))), "found")
    released(data)
    got = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("v"))  # two rows a name at most
    both = sizes.join(got, same(sizes, got, by)).select(*[sizes[c] for c in by], "n", *also, got["v"])
    below = {name: F.col("v")[F.floor(p).cast("long")] for name, p in place.items()}
    above = {name: F.col("v")[F.ceil(p).cast("long")] for name, p in place.items()}
    part = {name: p - F.floor(p) for name, p in place.items()}
    return both.select(*by, "n", *also, *[F.when(part[q] == 0, below[q]).otherwise(below[q] + (above[q] - below[q]) * part[q]).alias(q) for q in probs])


def unpivoted(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """column, dim, x (double): a row for each number of the numeric and array columns, whose components are dims."""

    def cell(name: str):
        one = lambda x, dim: F.struct(F.lit(name).alias("column"), dim.alias("dim"), x.cast("double").alias("x"))
        if df.schema[name].dataType.typeName() == "array":
            return F.transform(F.coalesce(F.col(name), F.array().cast(df.schema[name].dataType)), one)
        return F.array(one(F.col(name), F.lit(0)))

    return df.select(*by, F.inline(F.concat(*map(cell, columns))))


def column_statistics(df: DataFrame, columns: list[str], by: list[str] = (), low: float = 0.01, high: float = 0.99) -> DataFrame:
    """column, dim, n, mean, std (population), min, max, q01, q99 of every numeric column and array component."""
    keys = [*by, "column", "dim"]
    moments = {"mean": F.avg("x"), "std": F.stddev_pop("x"), "min": F.min("x"), "max": F.max("x")}
    return exact_quantiles(unpivoted(df, columns, list(by)), keys, "x", {"q01": low, "q99": high}, moments)


def medians_of(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """by, n and <metric>_median for each metric, all in one search."""
    long = unpivoted(df, metrics, by).drop("dim")
    q = exact_quantiles(long, [*by, "column"], "x", {"m": 0.5})
    return q.groupBy(*by).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("column") == m, F.col("m"))).alias(f"{m}_median") for m in metrics])
