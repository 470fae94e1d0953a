"""Scalar helpers: distances, ring laws, colours, labels, interpolation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import Vec


def squared(a: Vec, b: Vec, weight: Column | float = 1.0) -> Column:
    """Squared distance, the second point scaled by ``weight``."""
    return sum((p - q * weight) * (p - q * weight) for p, q in zip(a, b, strict=True))


def norm2(v: Vec) -> Column:
    return sum(x * x for x in v)


def finite(v: Vec) -> Column:
    ok = F.lit(True)
    for x in v:
        ok = ok & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return ok


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ratio_to_one(a: Column, b: Column) -> Column:
    return F.greatest(a, b) / F.least(a, b)


def wrap_angle(a: Column) -> Column:
    """To [-pi, pi]: the difference metric of rotations about one axis."""
    return F.atan2(F.sin(a), F.cos(a))


def depth_colour(distance: Column, near: float = 5.0, far: float = 50.0) -> list[Column]:
    """Blue for near over green to red for far, clamped."""
    s = (clamp(distance, near, far) - near) / (far - near)
    return [F.round(255 * F.greatest(F.lit(0.0), 1 - 2 * s)), F.round(255 * (1 - F.abs(2 * s - 1))), F.round(255 * F.greatest(F.lit(0.0), 2 * s - 1))]


def time_label(seconds: Column, origin: Column, wrap: bool = True) -> Column:
    """Tenths of a second since ``origin``, modulo 255."""
    label = ((seconds - origin) * 10 + 0.5).cast("int")
    return label % 255 if wrap else label


def ring_linear(degrees: Column, lower: float, upper: float, rings: int) -> Column:
    return ((degrees - lower) * ((rings - 1) / (upper - lower)) + 0.5).cast("int")


def ring_two_slopes(degrees: Column) -> Column:
    """64 beams: two a degree below -8.58, three above."""
    return F.when(degrees < -8.58, ((degrees + 24.33) * 2 + 0.5).cast("int")).otherwise(((degrees + 8.33) * 3 + 0.5).cast("int") + 32)


def ring_table(degrees: Column, angles: list[float]) -> Column:
    """Nearest entry of a rising table; halfway: the lower index."""
    table = F.array(*map(F.lit, angles))
    best = F.array_min(F.transform(table, lambda a, i: F.struct(F.abs(degrees - a).alias("d"), i.alias("i"))))
    return best["i"]


def barycentric(p: tuple[Column, Column], a, b, c) -> list[Column]:
    (px, py), (ax, ay), (bx, by), (cx, cy) = p, a, b, c
    det = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
    u = ((by - cy) * (px - cx) + (cx - bx) * (py - cy)) / det
    v = ((cy - ay) * (px - cx) + (ax - cx) * (py - cy)) / det
    return [u, v, 1 - u - v]


def grey(b: Column, g: Column, r: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def gaussian(x: Column, sigma: float) -> Column:
    return F.exp(-x * x / (2 * sigma * sigma))


def packed_ring(intensity: Column) -> Column:
    """Ring of an intensity that packs ring + seconds; a negative time gives the previous ring, as packing does."""
    return intensity.cast("int")


def cube(x: Column, edge: float = 50.0) -> Column:
    return F.floor((x + edge / 2) / edge)
