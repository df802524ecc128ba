"""Normalisers of one component and their inverses, by named mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(x: Column, mode: str, low: Column | None = None, high: Column | None = None, mean: Column | None = None, std: Column | None = None) -> Column:
    """q99 (low and high are quantiles; clipped to [-1, 1], a constant component is clipped as it is), mean_std (a
    constant component stays), min_max (a constant component is 0), scale (by the larger absolute end) or binary."""
    if mode == "q99":
        y = F.when(low != high, 2 * (x - low) / (high - low) - 1).otherwise(x)
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y))
    if mode == "mean_std":
        return F.when(std != 0, (x - mean) / std).otherwise(x)
    if mode == "min_max":
        return F.when(low != high, 2 * (x - low) / (high - low) - 1).otherwise(F.lit(0.0))
    if mode == "scale":
        most = F.greatest(F.abs(low), F.abs(high))
        return F.when(most != 0, x / most).otherwise(F.lit(0.0))
    if mode == "binary":
        return F.when(x > 0.5, 1.0).otherwise(0.0)
    raise ValueError(mode)


def restored(y: Column, mode: str, low: Column | None = None, high: Column | None = None, mean: Column | None = None, std: Column | None = None) -> Column:
    """The inverse; of q99 without what was clipped, of binary the threshold again. ``scale`` has none."""
    if mode in ("q99", "min_max"):
        return (y + 1) / 2 * (high - low) + low
    if mode == "mean_std":
        return y * std + mean
    if mode == "binary":
        return F.when(y > 0.5, 1.0).otherwise(0.0)
    raise ValueError(mode)


def continuous_action(bin_: Column, low: float, high: float, bins: int) -> Column:
    """The value of one of ``bins`` evenly spaced actions."""
    return bin_ / F.lit(bins - 1) * (high - low) + low


def sin_cos(v: Column) -> Column:
    return F.concat(F.transform(v, lambda x: F.sin(x.cast("double"))), F.transform(v, lambda x: F.cos(x.cast("double"))))


def position_embedding(at: Column, width: int) -> Column:
    """Sines, then cosines, of a place at width / 2 frequencies that fall from 1 to 1 / 10000."""
    half = width // 2
    waves = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: at / F.pow(F.lit(10000.0), i / half))
    return F.concat(F.transform(waves, F.sin), F.transform(waves, F.cos))


def multiplied(v: Column, factors: list[float]) -> Column:
    """A vector times fixed factors, one a component."""
    return F.zip_with(v, F.array(*[F.lit(float(f)) for f in factors]), lambda x, f: x.cast("double") * f)


def phase_features(current: Column, phase: Column, plan: Column) -> Column:
    """The current state, the phase, its square, and the plan in one vector."""
    return F.concat(current, F.array(phase, phase * phase), plan)


def relative_history(history: Column, mean: Column, std: Column) -> Column:
    """A history (array of states) less its last state, standardised by component, flattened, at length one; null for
    one of almost no length."""
    from strandway.functions.vectors import unit

    last = F.element_at(history, -1)
    each = lambda s: F.zip_with(F.zip_with(F.zip_with(s, last, lambda a, b: a - b), mean, lambda a, m: a - m), std, lambda a, d: a / d)
    return unit(F.flatten(F.transform(history, each)))


ABSOLUTE_BOUNDS = {"quaternion": (-1.0, 1.0), "six": (-1.0, 1.0), "matrix": (-1.0, 1.0), "euler": (-3.141592653589793, 3.141592653589793)}


def rotation_normalised(v: Column, source: str, target: str, relative: bool = False) -> Column:
    """A rotation in another form (euler, quaternion, six, matrix), by the form's own bounds within [-1, 1]. Relative
    rotations have no such bounds and raise a ValueError."""
    from strandway.functions import rotations as rot

    if relative:
        raise ValueError("a relative rotation has no fixed bounds")
    same = lambda m: m
    read = {"euler": rot.matrix_of_euler, "quaternion": rot.matrix_of_quaternion, "six": rot.matrix_of_6d, "matrix": same}[source]
    write = {"euler": rot.euler_of_matrix, "quaternion": rot.quaternion_of_matrix, "six": rot.six_of_matrix, "matrix": same}[target]
    low, high = ABSOLUTE_BOUNDS[target]
    return F.transform(rot.bound(read(v), write), lambda x: normalised(x.cast("double"), "min_max", F.lit(low), F.lit(high)))


def rotation_restored(v: Column, source: str, target: str) -> Column:
    """The inverse of rotation_normalised(v, source, target), in reverse order: bounds first, then the form."""
    from strandway.functions import rotations as rot

    same = lambda m: m
    low, high = ABSOLUTE_BOUNDS[target]
    read = {"euler": rot.matrix_of_euler, "quaternion": rot.matrix_of_quaternion, "six": rot.matrix_of_6d, "matrix": same}[target]
    write = {"euler": rot.euler_of_matrix, "quaternion": rot.quaternion_of_matrix, "six": rot.six_of_matrix, "matrix": same}[source]
    return rot.bound(read(F.transform(v, lambda x: restored(x, "min_max", F.lit(low), F.lit(high)))), write)
