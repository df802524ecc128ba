"""Run-length masks: runs of 0 and 1 by turns, written as text of 5-bit digits, read as intervals without a mask.

A count is written in digits of five bits, the lowest first, each a character from code 48 on; bit 5 says that another
digit follows, and bit 4 of the last one is the sign. From the fourth count on, the difference to the count two before
is written. The first run is one of zeros and may be empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Digits of one count at most: 60 bits.
DIGITS = 12
ONES = "array<struct<start:bigint,stop:bigint>>"


def encoded(lengths: Column) -> Column:
    """The text of run lengths (array of longs)."""

    def text(x: Column) -> Column:
        size = F.when(x < 0, -x - 1).otherwise(x)
        digits = F.when(size > 0, F.expr("1") + F.floor(F.length(F.bin(size)) / 5)).otherwise(F.lit(1)).cast("int")
        part = lambda j: F.call_function("shiftright", x, j * 5).bitwiseAND(F.lit(31)) + 48 + F.when(j < digits - 1, 32).otherwise(0)
        return F.array_join(F.transform(F.sequence(F.lit(0), digits - 1), lambda j: F.char(part(j))), "")

    deltas = F.transform(lengths, lambda x, i: F.when(i > 2, x - F.get(lengths, i - 2)).otherwise(x).cast("long"))
    return F.array_join(F.transform(deltas, text), "")


def masks(df: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """keys, size and counts: the encoded mask of each sequence; a null flag is 0. A mask is one cell."""
    w = W.partitionBy(*keys).orderBy(*order)
    d = df.select(*keys, *order, F.coalesce(flag, F.lit(False)).alias("_f")).withColumns({"_at": F.row_number().over(w) - 1, "_b": F.coalesce(F.lag("_f").over(w), F.lit(False))})
    cuts = d.groupBy(*keys).agg(F.count("*").alias("size"), F.sort_array(F.collect_list(F.when(F.col("_f") != F.col("_b"), F.col("_at")))).alias("_c"))
    ends = F.concat(F.col("_c").cast("array<bigint>"), F.array(F.col("size")))
    lengths = F.transform(ends, lambda x, i: x - F.when(i > 0, F.get(ends, i - 1)).otherwise(0))
    return cuts.select(*keys, "size", encoded(lengths).alias("counts"))


def decoded(counts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(ones, fault) of a batch of texts, all at once: intervals of ones, or what is wrong with a text.

    Faults: ``digit`` (a character outside 48 to 111), ``unfinished`` (the last digit announces another), ``long`` (a
    count over twelve digits), ``negative`` (a run below zero).
    """
    counts = counts.cast(pa.large_binary())
    n, null = len(counts), counts.is_null().to_numpy(zero_copy_only=False)
    sizes = np.array([0 if x is None else x for x in pa.compute.binary_length(counts).to_pylist()], np.int64)
    ends = np.cumsum(sizes)
    code = np.frombuffer(b"".join(x or b"" for x in counts.to_pylist()), np.uint8).astype(np.int64) - 48
    row = np.repeat(np.arange(n), sizes)
    fault = np.full(n, "", object)

    def fail(rows: np.ndarray, why: str) -> None:
        fault[rows[fault[rows] == ""]] = why

    fail(row[(code < 0) | (code > 63)], "digit")
    last = (code & 32) == 0
    tails = ends[sizes > 0] - 1
    fail(row[tails[~last[tails]]], "unfinished")
    last[tails] = True
    stop = np.flatnonzero(last)
    start = np.concatenate([[0], stop[:-1] + 1]).astype(np.int64)[: len(stop)]
    place = np.arange(len(code)) - np.repeat(start, stop - start + 1)
    fail(row[place >= DIGITS], "long")
    place = np.minimum(place, DIGITS - 1)
    x = np.add.reduceat((code & 31) << (5 * place), start) if len(start) else np.zeros(0, np.int64)
    x -= np.where(code[stop] & 16, 1 << (5 * (place[stop] + 1)), 0)
    of = row[stop]
    nth = np.arange(len(x)) - np.searchsorted(of, of)
    for kind in (nth % 2 == 1, (nth % 2 == 0) & (nth > 0)):  # differences to the run two before, added up within a text
        at = np.flatnonzero(kind)
        total = np.cumsum(x[at])
        first = np.searchsorted(of[at], of[at])
        x[at] = total - np.where(first > 0, total[first - 1], 0)
    fail(of[x < 0], "negative")
    upto = np.cumsum(x)
    first = np.searchsorted(of, of)
    upto -= np.where(first > 0, upto[first - 1], 0)
    use = (nth % 2 == 1) & (x > 0) & (fault[of] == "")
    cells = pa.StructArray.from_arrays([pa.array((upto - x)[use]), pa.array(upto[use])], ["start", "stop"])
    counted = np.bincount(of[use], minlength=n)
    ones = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counted)]).astype(np.int32)), cells, mask=pa.array(null | (fault != "")))
    return ones, pa.array([f or None for f in fault], pa.string())


def intervals(df: DataFrame, counts: str = "counts") -> DataFrame:
    """``df`` with ones, the intervals [start, stop) of ones in order, and fault, what is wrong with the text or null.

    A text with a fault and a null one have null ones; an empty one has none. What lies past the last run is 0.
    """
    given = df.select("*", F.col(counts).cast("binary").alias("_counts_"))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *decoded(batch.column(len(names)))], [*names, "ones", "fault"])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return given.mapInArrow(run, f"{schema}, ones {ONES}, fault string")


def clipped(ones: Column, start: Column, stop: Column) -> Column:
    """The intervals within rows [start, stop), counted from start. A range that ends before it begins, or begins
    below 0, is null."""
    inside = F.filter(ones, lambda x: (x["start"] < stop) & (x["stop"] > start))
    cut = F.transform(inside, lambda x: F.struct((F.greatest(x["start"], start) - start).alias("start"), (F.least(x["stop"], stop) - start).alias("stop")))
    return F.when((start >= 0) & (start < stop), cut)


def area(ones: Column) -> Column:
    """Rows that intervals cover."""
    return F.aggregate(ones, F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])


def frame_areas(df: DataFrame, keys: list[str], frame: int, ones: str = "ones") -> DataFrame:
    """keys, frame, area: how much of each frame of ``frame`` rows the intervals cover; frames without any are left out."""
    each = df.select(*keys, F.inline(ones))
    parts = each.select(*keys, "start", "stop", F.explode(F.sequence(F.expr(f"start div {frame}"), F.expr(f"(stop - 1) div {frame}"))).alias("frame"))
    covered = F.least("stop", (F.col("frame") + 1) * frame) - F.greatest("start", F.col("frame") * frame)
    return parts.groupBy(*keys, "frame").agg(F.sum(covered).alias("area"))
