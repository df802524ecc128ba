"""Vector functions over array columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The unit vector; null for a vector of almost no length."""
    n = norm(a)
    return F.when(n > 1e-12, F.transform(a, lambda x: x.cast("double") / n))


def combined(a: Column, b: Column) -> Column:
    """Both unit vectors end to end, at length one; null where either is null or has almost no length."""
    return F.transform(F.concat(unit(a), unit(b)), lambda x: x / F.sqrt(F.lit(2.0)))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def stepped(x: Column, digits: int) -> Column:
    """x to ``digits`` places as the whole number next to x * 10^digits, halves away from 0, over 10^digits: what SQL
    engines that calculate in doubles do. F.round goes by x's shortest decimal form, so 0.44999999999999996, whose
    product is 4.5, becomes 0.4 there and 0.5 here."""
    return F.round(x * 10.0**digits) / 10.0**digits


def circular_degrees(a: Column, b: Column) -> Column:
    d = F.abs(a - b) % 360
    return F.least(d, 360 - d)


def seed_of(text: Column) -> Column:
    """A stable 31-bit seed: the first eight bytes of sha256, masked."""
    return F.conv(F.substring(F.sha2(text, 256), 9, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))


def slices(v: Column, sizes: dict[str, int]) -> dict[str, Column]:
    """The parts of a vector by their sizes, in the declared order."""
    at, parts = 1, {}
    for name, size in sizes.items():
        parts[name] = F.slice(v, at, size)
        at += size
    return parts


def joined(*parts: Column) -> Column:
    return F.concat(*parts)


def dropped_out(v: Column, u: Column, p: float) -> Column:
    """A vector of doubles; zeros where the draw ``u`` is under ``p``, else the vector."""
    return F.when(u < p, F.transform(v, lambda x: F.lit(0).cast("double"))).otherwise(v)


def pooled(latent: Column) -> Column:
    """The mean of each channel (an array of places) as one vector of length one; null where it has almost no length."""
    mean = F.transform(latent, lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(c))
    return F.element_at(F.transform(F.array(mean), unit), 1)
