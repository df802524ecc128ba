"""Repeatable uniform numbers and choices from a hash, the same on every run and engine."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(name: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / 2.0**32


def uniform_sql(name: str) -> str:
    """The same in the twins' SQL."""
    return f"(CAST('0x' || substr(md5({name}), 1, 8) AS UBIGINT) / 4294967296.0)"


def weighted(u: Column, weights: dict[str, float]) -> Column:
    """The name whose share of the total weight holds ``u``; the weights needn't sum to one."""
    total = sum(weights.values())
    ends = list(zip(weights, accumulate(w / total for w in weights.values()), strict=True))
    choice = F.lit(ends[-1][0])
    for name, end in reversed(ends[:-1]):
        choice = F.when(u < end, name).otherwise(choice)
    return choice
