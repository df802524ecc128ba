"""Whole numbers in the order of doubles, by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of a binary64 number: the first number past the fraction, the exponent's bias, the least normal exponent.
UNIT, BIAS, LEAST = 1 << 52, 1023, -1022
INFINITE, NAN = 2047 * UNIT, (1 << 63) - 1


def image(x: Column) -> Column:
    """A long for a double: the lesser double has the lesser one, equal ones (0.0 and -0.0 too) the same, NaN the
    largest; null stays null.

    Of a positive number it is what its bits say as an integer, so numbers near each other have images near each other
    at every magnitude. The exponent comes from log2 and is put right by comparison with exact powers of two.
    """
    a = F.abs(x)
    rough = F.floor(F.log2(a))
    power = F.pow(F.lit(2.0), rough)
    exponent = rough - (power > a).cast("int") + (power * 2 <= a).cast("int")
    normal = (exponent + BIAS) * UNIT + ((a / F.pow(F.lit(2.0), exponent) - 1) * float(UNIT)).cast("long")
    small = (a * 2.0**537 * 2.0**537).cast("long")
    size = F.when(F.isnan(x), NAN).when(a == float("inf"), INFINITE).when(a < 2.0**LEAST, small).otherwise(normal)
    return size * F.when(x < 0, -1).when(x.isNotNull(), 1)  # size stands once, as it is long when compiled


def value(i: Column) -> Column:
    """The double of an image."""
    a = F.abs(i)
    exponent = F.floor(F.shiftright(a, 52))
    fraction = a.bitwiseAND(F.lit(UNIT - 1)).cast("double")
    normal = (fraction / float(UNIT) + 1) * F.pow(F.lit(2.0), exponent - BIAS)
    size = F.when(a == NAN, float("nan")).when(a == INFINITE, float("inf")).when(exponent == 0, fraction * 2.0**-1074).otherwise(normal)
    return F.when(i < 0, -size).otherwise(size)
