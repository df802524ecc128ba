"""Regular-expression matches with their places, in DataFrame functions only.

Arrays are walked in blocks of about the square root of their length, so that neither the growing of an array in an
aggregate nor a search among its items is quadratic in the matches of a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def hits(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once; within a lambda function it would be computed for each item."""
    return F.element_at(F.transform(F.array(value), use), 1)


def blocks(items: Column) -> Column:
    """The items in blocks of about the square root of their number, in order; no blocks without items."""

    def cut(xs: Column) -> Column:
        n = F.size(xs)
        size = F.ceil(F.sqrt(n)).cast("int")
        starts = F.when(n > 0, F.sequence(F.lit(1), n, size)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(xs, i, size))

    return let(items, cut)


def running(lengths: Column) -> Column:
    """The sum of the lengths before each one, as arrays by block."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
    none = F.array().cast("array<int>")

    def before(xs: Column, first: Column) -> Column:
        zero = F.struct(first.alias("at"), none.alias("out"))
        return F.aggregate(xs, zero, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def each(parts: Column) -> Column:
        return F.zip_with(parts, before(F.transform(parts, total), F.lit(0)), before)

    return let(blocks(lengths), each)


def placed(text: Column, pattern: str, found: Column) -> Column:
    """Of each of the matches ``found``: hit, start and stop in code points, stop exclusive.

    What stands between matches comes from a split by the same pattern, which only texts with a match pay for.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, h: g + F.length(h))
    ends = let(steps, lambda ns: F.zip_with(F.flatten(running(ns)), ns, lambda at, n: at + n))
    spans = F.zip_with(found, ends, lambda h, stop: F.struct(h.alias("hit"), (stop - F.length(h)).alias("start"), stop.alias("stop")))
    empty = F.expr("CAST(array() AS array<struct<hit:string,start:int,stop:int>>)")
    return F.when(F.size(found) > 0, spans).otherwise(empty)


def grouped(spans: Column) -> Column:
    """(start, stop) of the spans by start, in blocks with the least start (lo) and the greatest stop (hi)."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))
    return F.transform(blocks(order), lambda b: F.struct(b[0]["start"].alias("lo"), F.array_max(F.transform(b, lambda s: s["stop"])).alias("hi"), b.alias("spans")))


def near(x: Column, others: Column, scope: int) -> Column:
    """Whether one of the ``grouped`` spans lies within ``scope`` code points of the span x. Blocks that lie further
    away are left out by their ends."""
    within = lambda start, stop: (start <= x["stop"] + scope) & (x["start"] <= stop + scope)
    return F.exists(others, lambda b: within(b["lo"], b["hi"]) & F.exists(b["spans"], lambda y: within(y["start"], y["stop"])))
