"""Rotations as array columns: six numbers (the first two columns of a matrix) or nine (a matrix row by row)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandway.functions.vectors import dot, norm


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, as what uses it names it many times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _unit(v: Column) -> Column:
    return bound(v, lambda own: bound(F.greatest(norm(own), F.lit(1e-12)), lambda n: F.transform(own, lambda x: x / n)))


def _at(v: Column, i: int) -> Column:
    return F.element_at(v, i + 1).cast("double")


def cross(a: Column, b: Column) -> Column:
    return F.array(*[_at(a, i) * _at(b, j) - _at(a, j) * _at(b, i) for i, j in ((1, 2), (2, 0), (0, 1))])


def matrix_of_6d(six: Column) -> Column:
    """The matrix whose first column is the unit of the first three numbers, and whose second the unit of the rest of
    the last three, by Gram-Schmidt."""

    def rest(a: Column, b: Column) -> Column:
        second = bound(dot(a, b), lambda d: _unit(F.zip_with(b, a, lambda x, f: x.cast("double") - f * d)))
        return bound(second, lambda c: bound(cross(a, c), lambda third: F.array(*[_at(v, i) for i in range(3) for v in (a, c, third)])))

    return bound(six, lambda own: bound(_unit(F.slice(own, 1, 3)), lambda a: rest(a, F.slice(own, 4, 3))))


def six_of_matrix(m: Column) -> Column:
    return F.array(*[_at(m, 3 * i + c) for c in range(2) for i in range(3)])


def product(a: Column, b: Column) -> Column:
    each = lambda x, y: F.array(*[sum((_at(x, 3 * i + k) * _at(y, 3 * k + j) for k in range(1, 3)), _at(x, 3 * i) * _at(y, j)) for i in range(3) for j in range(3)])
    return bound(a, lambda x: bound(b, lambda y: each(x, y)))


def transposed(m: Column) -> Column:
    return F.array(*[_at(m, 3 * j + i) for i in range(3) for j in range(3)])


def geodesic(a: Column, b: Column) -> Column:
    """The angle between two matrices in radians; the trace of the product with the transpose is their dot product."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (dot(a, b) - 1) / 2)))


def aligned(pose: Column, first: Column, anchor: Column) -> Column:
    """A pose (place 3, matrix 9) of a plan carried from the plan's first pose to the anchor: places by the
    translation, rotations by anchor times the inverse of the first."""
    place = F.array(*[_at(anchor, i) + _at(pose, i) - _at(first, i) for i in range(3)])
    turn = product(product(F.slice(anchor, 4, 9), transposed(F.slice(first, 4, 9))), F.slice(pose, 4, 9))
    return F.concat(place, turn)


def matrix_of_quaternion(q: Column) -> Column:
    """The matrix of a quaternion x, y, z, w of any length."""
    s = 2 / dot(q, q)
    x, y, z, w = (_at(q, i) for i in range(4))
    return F.array(
        1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w),
        s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w),
        s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y),
    )


def relative_to(x: Column, y: Column, block_x: Column, block_y: Column, yaw: Column) -> Column:
    """A place as seen from a block that is turned by ``yaw`` radians."""
    dx, dy, c, s = x - block_x, y - block_y, F.cos(-yaw), F.sin(-yaw)
    return F.struct((c * dx - s * dy).alias("x"), (s * dx + c * dy).alias("y"))


def matrix_of_euler(angles: Column, order: str = "xyz") -> Column:
    """The matrix of three angles in radians, turned about fixed axes in the order of their names."""
    turns = {
        "x": lambda a: (1, 0, 0, 0, F.cos(a), -F.sin(a), 0, F.sin(a), F.cos(a)),
        "y": lambda a: (F.cos(a), 0, F.sin(a), 0, 1, 0, -F.sin(a), 0, F.cos(a)),
        "z": lambda a: (F.cos(a), -F.sin(a), 0, F.sin(a), F.cos(a), 0, 0, 0, 1),
    }
    each = [F.array(*[F.lit(v).cast("double") if isinstance(v, int) else v for v in turns[axis](_at(angles, i))]) for i, axis in enumerate(order)]
    return bound(each[0], lambda a: bound(each[1], lambda b: bound(product(b, a), lambda ab: bound(each[2], lambda c: product(c, ab)))))


def euler_of_matrix(m: Column) -> Column:
    """The xyz angles of a matrix; where the middle one is a right angle the first is 0."""
    upright = F.sqrt(_at(m, 0) * _at(m, 0) + _at(m, 3) * _at(m, 3))
    flat = upright < 1e-6
    return F.array(
        F.when(flat, F.lit(0.0)).otherwise(F.atan2(_at(m, 7), _at(m, 8))), F.atan2(-_at(m, 6), upright), F.when(flat, F.atan2(-_at(m, 1), _at(m, 4))).otherwise(F.atan2(_at(m, 3), _at(m, 0)))
    )


def quaternion_of_matrix(m: Column) -> Column:
    """x, y, z, w of length one with w not negative."""
    half = lambda v: F.sqrt(F.greatest(F.lit(0.0), 1 + v)) / 2
    a, b, c = _at(m, 0), _at(m, 4), _at(m, 8)
    w, x, y, z = half(a + b + c), half(a - b - c), half(b - a - c), half(c - a - b)
    like = lambda v, s: F.when(s < 0, -v).otherwise(v)
    # the largest part is taken from the diagonal, the signs of the others from the differences or sums around it
    by_w = F.array(like(x, _at(m, 7) - _at(m, 5)), like(y, _at(m, 2) - _at(m, 6)), like(z, _at(m, 3) - _at(m, 1)), w)
    by_x = F.array(x, like(y, _at(m, 1) + _at(m, 3)), like(z, _at(m, 2) + _at(m, 6)), w)
    by_y = F.array(like(x, _at(m, 1) + _at(m, 3)), y, like(z, _at(m, 5) + _at(m, 7)), w)
    by_z = F.array(like(x, _at(m, 2) + _at(m, 6)), like(y, _at(m, 5) + _at(m, 7)), z, w)
    return F.when(w > 1e-6, by_w).when((x >= y) & (x >= z), by_x).when(y >= z, by_y).otherwise(by_z)


def pose_of_euler(pose: Column, gripper: Column, scale: float) -> Column:
    """Ten numbers of a pose of place and xyz angles in degrees: the place scaled, the first two columns of the matrix,
    the gripper."""
    place = F.transform(F.slice(pose, 1, 3), lambda x: x.cast("double") * scale)
    turn = bound(matrix_of_euler(F.transform(F.slice(pose, 4, 3), lambda a: F.radians(a.cast("double")))), six_of_matrix)
    return F.concat(place, turn, F.array(gripper.cast("double")))


def projected(prediction: Column, current: Column) -> Column:
    """Ten predicted numbers with a proper rotation and the gripper within [0, 1], and fell_back: where the rotation is
    degenerate the current one stands in."""
    bad = (norm(F.slice(prediction, 4, 3)) < 1e-8) | (norm(cross(F.slice(prediction, 4, 3), F.slice(prediction, 7, 3))) < 1e-8)
    turn = F.when(bad, F.slice(current, 4, 6).cast("array<double>")).otherwise(bound(matrix_of_6d(F.slice(prediction, 4, 6)), six_of_matrix))
    grip = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _at(prediction, 9)))
    return F.struct(F.concat(F.slice(prediction, 1, 3).cast("array<double>"), turn, F.array(grip)).alias("pose"), bad.alias("fell_back"))
