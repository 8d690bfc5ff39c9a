"""Scalar geometry as Column expressions. A vector is a triple of Columns. Everything stays in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str = "", suffix: str = "") -> Vec:
    """Columns prefix + x/y/z + suffix."""
    return tuple(F.col(f"{prefix}{c}{suffix}") for c in "xyz")


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vec, b: Vec) -> Column:
    """Edge length or vertex distance."""
    return norm(sub(a, b))


def unit(a: Vec) -> Vec:
    """The zero vector stays."""
    n = norm(a)
    return tuple(F.when(n > 0, c / n).otherwise(F.lit(0.0)) for c in a)


def heron_area(l1: Column, l2: Column, l3: Column) -> Column:
    """Triangle area of the lengths |ab|, |bc|, |ac| by their squares."""
    a, b, c = l1 * l1, l2 * l2, l3 * l3
    s = a - b + c
    return 0.25 * F.sqrt(F.abs(4.0 * a * c - s * s))


def triangle_normal(a: Vec, b: Vec, c: Vec) -> Vec:
    return unit(cross(sub(b, a), sub(c, a)))


def angle(opposite: Column, s1: Column, s2: Column) -> Column:
    """Angle in radians opposite a side; 0 for degenerate triangles."""
    cosine = (s1 * s1 + s2 * s2 - opposite * opposite) / (2.0 * s1 * s2)
    return F.when((s1 > 0) & (s2 > 0), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))).otherwise(F.lit(0.0))


def min_angle(l1: Column, l2: Column, l3: Column) -> Column:
    """Least angle in degrees."""
    return F.degrees(F.least(angle(l1, l2, l3), angle(l2, l1, l3), angle(l3, l1, l2)))


def quality(area: Column, l1: Column, l2: Column, l3: Column) -> Column:
    """1 for equilateral triangles, 0 for degenerate ones."""
    below = (l1 + l2 + l3) * F.greatest(l1, l2, l3)
    return F.when(below > 0, 12.0 / math.sqrt(3.0) * area / below).otherwise(F.lit(0.0))


def delaunay_excess(opposite_sum: Column) -> Column:
    """Sum of the angles opposite an edge minus pi: positive where the edge is not Delaunay."""
    return opposite_sum - F.lit(math.pi)


def rescaled(p: Column, low: Column, widest: Column) -> Column:
    """To a unit widest range, shifted by a half."""
    return F.when(widest > 0, (p - low) / widest).otherwise(F.lit(0.0)) - 0.5


def quantised(p: Column, low: Column, factor: Column) -> Column:
    return F.floor((p - low) * factor + 0.5).cast("long")


def quantise_factor(bits: int, widest: Column) -> Column:
    return F.when(widest > 0, F.lit(float(2**bits - 1)) / widest).otherwise(F.lit(0.0))


def unquantised(q: Column, low: Column, factor: Column) -> Column:
    return F.when(factor > 0, q / factor).otherwise(F.lit(0.0)) + low


QUADRIC = ["q0", "q1", "q2", "q3", "q4", "q5", "q6", "q7", "q8", "q9"]


def plane_quadric(n: Vec, d: Column, weight: Column) -> list[Column]:
    """aa ab ac ad bb bc bd cc cd dd of the plane n.p + d = 0, times a weight."""
    p = [*n, d]
    return [weight * p[i] * p[j] for i in range(4) for j in range(i, 4)]


def triangle_quadric(a: Vec, b: Vec, c: Vec) -> list[Column]:
    """Quadric of a triangle's plane, weighted by its area."""
    raw = cross(sub(b, a), sub(c, a))
    n = unit(raw)
    return plane_quadric(n, -dot(n, a), 0.5 * norm(raw))


def quadric_value(q: list[Column], p: Vec) -> Column:
    x, y, z = p
    return q[0] * x * x + 2 * q[1] * x * y + 2 * q[2] * x * z + 2 * q[3] * x + q[4] * y * y + 2 * q[5] * y * z + 2 * q[6] * y + q[7] * z * z + 2 * q[8] * z + q[9]


def signed_tetra(a: Vec, b: Vec, c: Vec) -> Column:
    """Signed volume of the tetrahedron from the origin."""
    return dot(a, cross(b, c)) / 6.0


def ramp_colour(t: Column) -> list[Column]:
    """Red, green and blue (0 to 1) of full brightness for t clamped to 0..1: the hue runs from 0.3 to 1 turn, the saturation is t itself."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    sector = (0.3 + 0.7 * t) * 6.0
    channel = lambda n: 1.0 - t * F.greatest(F.lit(0.0), F.least(F.pmod(sector + n, F.lit(6.0)), 4.0 - F.pmod(sector + n, F.lit(6.0)), F.lit(1.0)))
    return [channel(n) for n in (5.0, 3.0, 1.0)]


def shift_scale(v: Column, shift: float, scale: float, kind: str) -> Column:
    return ((v + F.lit(shift)) * F.lit(scale)).cast(kind)


def thresholded(v: Column, at: float, inside: int = 1, outside: int = 0) -> Column:
    return F.when(v >= F.lit(at), F.lit(inside)).otherwise(F.lit(outside))
