"""Poses, action axes and plain geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from episodium import dims


def normalise(value: Column, axis: str) -> Column:
    """Axis value scaled to 0..1 by the axis bounds."""
    low, high, _ = dims.AXIS_SPEC[axis]
    return (value - F.lit(float(low))) / F.lit(float(high) - float(low))


def denormalise(value: Column, axis: str) -> Column:
    """Inverse of :func:`normalise`."""
    low, high, _ = dims.AXIS_SPEC[axis]
    return value * F.lit(float(high) - float(low)) + F.lit(float(low))


def count_boundaries(unit: Column, bins: Column) -> Column:
    """How many of ``bins`` evenly spaced boundaries of [0, 1] lie below ``unit``."""
    gaps = (bins - 1).cast("double")
    guess = F.ceil(unit * gaps)
    exact = (
        F.when((guess - 1) / gaps >= unit, guess - 1)
        .when(guess / gaps < unit, guess + 1)
        .otherwise(guess)
    )
    return F.greatest(F.lit(0), F.least(bins, exact)).cast("bigint")


def discretise(unit: Column, axis: str) -> Column:
    """Token of a value that is scaled to 0..1."""
    return count_boundaries(unit, F.lit(dims.AXIS_SPEC[axis][2]))


def continuous(token: Column, axis: str) -> Column:
    """Token back to an axis value.  Tokens divide by ``bins``, so this is not an exact inverse."""
    bins = dims.AXIS_SPEC[axis][2]
    return denormalise(F.least(token, F.lit(bins)) / F.lit(float(bins)), axis)


def clamp(value: Column, axis: str) -> Column:
    """Axis value cut to the axis bounds."""
    low, high, _ = dims.AXIS_SPEC[axis]
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def close_to(value: Column, target: float) -> Column:
    """Equality within the usual floating-point tolerances (1e-8 absolute, 1e-5 relative)."""
    return F.abs(value - F.lit(target)) <= F.lit(1e-8 + 1e-5 * abs(target))


def all_close(values: list[Column], targets: tuple[float, ...]) -> Column:
    """:func:`close_to` for every pair."""
    result = F.lit(True)
    for value, target in zip(values, targets, strict=True):
        result = result & close_to(value, target)
    return result


def in_workspace(x: Column, y: Column) -> Column:
    """Whether a point lies on the table."""
    return x.between(*dims.WORKSPACE_X) & y.between(*dims.WORKSPACE_Y)


def distance(*pairs: tuple[Column, Column]) -> Column:
    """Euclidean distance over coordinate pairs."""
    total = F.lit(0.0)
    for a, b in pairs:
        total = total + (a - b) * (a - b)
    return F.sqrt(total)


def rotation_error(a: Column, b: Column, symmetry: Column) -> Column:
    """Difference of two z angles for an object with rotational symmetry; 0 when symmetry is 0."""
    raw = F.abs(a - b)
    folded = raw - F.floor(raw / symmetry) * symmetry
    return F.when(
        symmetry > 0, F.when(folded > symmetry / 2, symmetry - folded).otherwise(folded)
    ).otherwise(F.lit(0.0))


def poses_match(
    ax: Column, ay: Column, a_angle: Column, bx: Column, by: Column, b_angle: Column,
    symmetry: Column, position_only: bool = False,
) -> Column:
    """Two poses agree in the plane and, unless told otherwise, in rotation about z."""
    near = distance((ax, bx), (ay, by)) < dims.POSITION_TOLERANCE
    if position_only:
        return near
    return near & (rotation_error(a_angle, b_angle, symmetry) < dims.ROTATION_TOLERANCE)


def quaternion_matrix(x: Column, y: Column, z: Column, w: Column) -> list[list[Column]]:
    """Rotation matrix of a quaternion of any length."""
    s = F.lit(2.0) / (x * x + y * y + z * z + w * w)
    one = F.lit(1.0)
    return [
        [one - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w)],
        [s * (x * y + z * w), one - s * (x * x + z * z), s * (y * z - x * w)],
        [s * (x * z - y * w), s * (y * z + x * w), one - s * (x * x + y * y)],
    ]


def quaternion_to_euler(x: Column, y: Column, z: Column, w: Column) -> list[Column]:
    """Angles about x, y, z for rotations applied in the order z, x, y.

    Where x turns by a right angle, z and y turn about the same line; all of it goes to z then.
    """
    m = quaternion_matrix(x, y, z, w)
    level = F.sqrt(m[2][2] * m[2][2] + m[0][2] * m[0][2])
    regular = level > 1e-9
    return [
        F.atan2(-m[1][2], level),
        F.when(regular, F.atan2(m[0][2], m[2][2])).otherwise(F.lit(0.0)),
        F.when(regular, F.atan2(m[1][0], m[1][1])).otherwise(F.atan2(-m[0][1], m[0][0])),
    ]


def quaternion_product(a: list[Column], b: list[Column]) -> list[Column]:
    """Hamilton product of two quaternions given as x, y, z, w."""
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return [
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
        aw * bw - ax * bx - ay * by - az * bz,
    ]


def euler_to_quaternion(x: Column, y: Column, z: Column) -> list[Column]:
    """Quaternion (x, y, z, w) of rotations applied in the order z, x, y."""
    zero = F.lit(0.0)
    half = [angle / F.lit(2.0) for angle in (x, y, z)]
    turn_x = [F.sin(half[0]), zero, zero, F.cos(half[0])]
    turn_y = [zero, F.sin(half[1]), zero, F.cos(half[1])]
    turn_z = [zero, zero, F.sin(half[2]), F.cos(half[2])]
    return quaternion_product(turn_y, quaternion_product(turn_x, turn_z))


def move_point(point: list[Column], position: list[Column], quaternion: list[Column]) -> list[Column]:
    """A point carried along by a pose."""
    m = quaternion_matrix(*quaternion)
    return [
        m[row][0] * point[0] + m[row][1] * point[1] + m[row][2] * point[2] + position[row]
        for row in range(3)
    ]


def no_rotational_symmetry(symmetry: Column) -> Column:
    """Whether only a full turn maps the object on itself."""
    full = 2 * math.pi
    tolerance = F.greatest(
        F.lit(1e-6) * F.greatest(F.abs(symmetry), F.lit(full)), F.lit(1e-8)
    )
    return F.abs(symmetry - F.lit(full)) <= tolerance


def pixel_to_world(u: Column, v: Column, low_x: float, low_y: float, size: float) -> list[Column]:
    """Map pixel (row u, column v) to x, y."""
    return [F.lit(low_x) + v * F.lit(size), F.lit(low_y) + u * F.lit(size)]


def world_to_pixel(x: Column, y: Column, low_x: float, low_y: float, size: float) -> list[Column]:
    """x, y to the pixel (row u, column v) it rounds to; halves go to the even pixel."""
    return [
        F.rint((y - F.lit(low_y)) / F.lit(size)).cast("bigint"),
        F.rint((x - F.lit(low_x)) / F.lit(size)).cast("bigint"),
    ]


def depth_to_point(px: Column, py: Column, depth: Column, fx: float, fy: float, cx: float, cy: float) -> list[Column]:
    """Pixel and depth to a camera-space point of a pinhole camera."""
    return [
        (px - F.lit(cx)) * (depth / F.lit(fx)),
        (py - F.lit(cy)) * (depth / F.lit(fy)),
        depth,
    ]


def darken(r: Column, g: Column, b: Column, by: float = dims.DARKEN_BY) -> list[Column]:
    """Colour with its brightness lowered; hue and saturation stay."""
    value = F.greatest(r, g, b)
    factor = F.when(value > 0, F.greatest(F.lit(0.0), value - F.lit(by)) / value).otherwise(
        F.lit(0.0)
    )
    return [r * factor, g * factor, b * factor]
