"""Planar geometry of points and segments as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared(ax, ay, bx, by) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def point_segment_distance(ax, ay, bx, by, px, py) -> Column:
    """Distance of p to segment a-b, clamped to its ends; a segment without length counts as the point a."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = ((px - ax) * dx + (py - ay) * dy) / F.nullif(n * 1.0, F.lit(0.0))
    s = F.when(n == 0, F.lit(0.0)).when(t < 0, F.lit(0.0)).when(t > 1, F.lit(1.0)).otherwise(t)
    ex, ey = px - (ax + s * dx), py - (ay + s * dy)
    return F.sqrt(ex * ex + ey * ey)


def point_segment_distance_latlon(lat1, lon1, lat2, lon2, lat, lon) -> Column:
    """The same in degrees, longitude scaled at the segment's first end."""
    k = F.cos(F.radians(lat1))
    zero = F.lit(0.0)
    return point_segment_distance(zero, zero, lat2 - lat1, (lon2 - lon1) * k, lat - lat1, (lon - lon1) * k)


def segment_box(ax, ay, bx, by, pad=1) -> tuple[Column, Column, Column, Column]:
    return F.least(ax, bx) - pad, F.least(ay, by) - pad, F.greatest(ax, bx) + pad, F.greatest(ay, by) + pad


def _turn(ax, ay, bx, by, px, py) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def crossing_point(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Where two segments cross, as struct(x, y); NULL when parallel, apart or only touching at an end."""
    c, d = _turn(ax, ay, bx, by, cx, cy), _turn(ax, ay, bx, by, dx, dy)
    a, b = _turn(cx, cy, dx, dy, ax, ay), _turn(cx, cy, dx, dy, bx, by)
    proper = (c * d < 0) & (a * b < 0)
    t = a / F.nullif((a - b) * 1.0, F.lit(0.0))
    return F.when(proper, F.struct((ax + t * (bx - ax)).alias("x"), (ay + t * (by - ay)).alias("y")))


def ray_hit(base_x, base_y, dir_x, dir_y, ax, ay, bx, by) -> Column:
    """Where a ray meets the segment a-b, as struct(x, y, reach); NULL when it does not."""
    tip_x, tip_y = base_x + dir_x, base_y + dir_y
    away = _turn(ax, ay, bx, by, base_x, base_y)  # how far the base is off the segment's line, and how fast the ray nears it
    nears = F.nullif((away - _turn(ax, ay, bx, by, tip_x, tip_y)) * 1.0, F.lit(0.0))
    side_a, side_b = _turn(base_x, base_y, tip_x, tip_y, ax, ay), _turn(base_x, base_y, tip_x, tip_y, bx, by)
    t = away / nears
    meets = (t >= 0) & (F.least(side_a, side_b) <= 0) & (F.greatest(side_a, side_b) >= 0)
    # one division at the end: with whole-number coordinates the place is rounded once only
    at = lambda base, way: (base * nears + away * way) / nears
    return F.when(meets, F.struct(
        at(base_x, dir_x).alias("x"), at(base_y, dir_y).alias("y"), (t * F.hypot(dir_x * 1.0, dir_y * 1.0)).alias("reach")))
