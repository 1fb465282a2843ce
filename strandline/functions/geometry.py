"""Boxes and homographies as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column, least_union: float = 0.0) -> Column:
    """Overlap over union of (x, y, w, h) boxes; ``least_union`` bounds the denominator below."""
    w = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    inter = w * h
    union = aw * ah + bw * bh - inter
    union = F.greatest(F.lit(least_union), union) if least_union else union
    return F.when(union > 0, inter / union).otherwise(0.0)


def corners(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))


def from_foot(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Box of a foot point (bottom centre) and a size."""
    return corners(x - w / 2, y - h, w, h)


def _at(m: Column, i: int) -> Column:
    return F.element_at(m, i + 1)


def multiply(a: Column, b: Column) -> Column:
    """Product of two row-major 3x3 matrices."""
    return F.array(*[sum((_at(a, 3 * r + k) * _at(b, 3 * k + c) for k in range(3)), F.lit(0.0)) for r in range(3) for c in range(3)])


def determinant(m: Column) -> Column:
    a, b, c, d, e, f, g, h, i = (_at(m, k) for k in range(9))
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def inverse(m: Column, least: float = 1e-10) -> Column:
    """Null where the determinant is about 0."""
    a, b, c, d, e, f, g, h, i = (_at(m, k) for k in range(9))
    det = determinant(m)
    adj = (e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d)
    return F.when(F.abs(det) > least, F.array(*[x / det for x in adj]))


def project(m: Column, x: Column, y: Column) -> Column:
    """struct(x, y) of a point under a homography; null at infinity."""
    w = _at(m, 6) * x + _at(m, 7) * y + _at(m, 8)
    px = (_at(m, 0) * x + _at(m, 1) * y + _at(m, 2)) / w
    py = (_at(m, 3) * x + _at(m, 4) * y + _at(m, 5)) / w
    return F.when(F.abs(w) > 1e-12, F.struct(px.alias("x"), py.alias("y")))


def metric_projection(x: Column, z: Column, length: float, width: float, margin: float = 4.0) -> Column:
    """struct(x, z, reason): outside the pitch by more than ``margin`` is rejected, less is clamped."""
    ox = F.abs(x) - length / 2
    oz = F.abs(z) - width / 2
    inside = (ox <= 0) & (oz <= 0)
    out = (ox > margin) | (oz > margin)
    cx = F.least(F.lit(length / 2), F.greatest(F.lit(-length / 2), x))
    cz = F.least(F.lit(width / 2), F.greatest(F.lit(-width / 2), z))
    reason = F.when(x.isNull() | z.isNull(), "missing").when(out, "outside").when(inside, "inside").otherwise("clamped")
    return F.struct(F.when(~out, cx).alias("x"), F.when(~out, cz).alias("z"), reason.alias("reason"))
