"""Coordinate frames, keys and distances as column expressions.

Frames: ``rc`` image row/column, ``xy`` = (column, row), ``latlon`` a synthetic frame in which one pixel is one
metre and 1/111111 of a degree, hung from the corner (41, -71).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the synthetic latlon frame.
TOP_LAT = 41.0
LEFT_LON = -71.0
METRES_PER_DEGREE = 111111.0
# Fixed value: the margin test uses this short form of pi.
SHORT_PI = 3.1415926


def rc_to_xy(r: Column, c: Column) -> tuple[Column, Column]:
    return c, r


def native_to_xy(v0: Column, v1: Column, size: int = 400) -> tuple[Column, Column]:
    return v1, F.lit(size) - v0


def xy_to_native(x: Column, y: Column, size: int = 400) -> tuple[Column, Column]:
    return F.lit(size) - y, x


def to_latlon(first: Column, second: Column) -> tuple[Column, Column]:
    """(row, col) in pixels to (lat, lon)."""
    lat = F.lit(TOP_LAT) - first / METRES_PER_DEGREE
    lon = F.lit(LEFT_LON) + second / METRES_PER_DEGREE / F.cos(F.radians(F.lit(TOP_LAT)))
    return lat, lon


def latlon_to_pixel(lat, lon, min_lat, min_lon, max_lat, max_lon, rows: int, cols: int) -> tuple[Column, Column]:
    """(lat, lon) to (row, col); rows count down from the top and fractions are cut off."""
    r = F.lit(rows) - ((lat - min_lat) / ((max_lat - min_lat) / rows)).cast("int")
    c = ((lon - min_lon) / ((max_lon - min_lon) / cols)).cast("int")
    return r, c


def degree_distance(lat1, lon1, lat2, lon2) -> Column:
    """Equirectangular distance in degrees, scaled at the first point's latitude."""
    a = lat1 - lat2
    b = (lon1 - lon2) * F.cos(F.radians(lat1))
    return F.sqrt(a * a + b * b)


def metre_distance(lat1, lon1, lat2, lon2) -> Column:
    a = (lat1 - lat2) * METRES_PER_DEGREE
    b = (lon1 - lon2) * METRES_PER_DEGREE * F.cos(F.radians(lat1))
    return F.sqrt(a * a + b * b)


def unit_direction(dlat, dlon, ref_lat: float = 40.0) -> tuple[Column, Column]:
    """Direction of length 1 with longitude scaled at ``ref_lat``; NULL for a zero vector."""
    s = dlon * F.cos(F.radians(F.lit(ref_lat)))
    n = F.nullif(F.sqrt(s * s + dlat * dlat), F.lit(0.0))
    return dlat / n, s / n


def angle_gap(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """1 - |cos| of two unit directions: 0 when parallel either way."""
    return 1.0 - F.abs(a[0] * b[0] + a[1] * b[1])


def direction_distance(a0, a1, b0, b1) -> Column:
    """L2 distance of the two normalized directions; 100000 when one has no length."""
    la, lb = F.sqrt(a0 * a0 + a1 * a1), F.sqrt(b0 * b0 + b1 * b1)
    na, nb = F.nullif(la, F.lit(0.0)), F.nullif(lb, F.lit(0.0))
    p, q = a0 / na - b0 / nb, a1 / na - b1 / nb
    return F.when((la == 0) | (lb == 0), F.lit(100000.0)).otherwise(F.sqrt(p * p + q * q))


def in_tile(lat, lon, region: float = 2048.0, margin: float = 100.0) -> Column:
    """Strictly inside the fixed tile minus a margin, both in metres."""
    k = F.cos(F.lit(TOP_LAT / 180.0 * SHORT_PI))
    low_lat = F.lit(TOP_LAT) - region / METRES_PER_DEGREE
    high_lon = F.lit(LEFT_LON) + F.lit(region / METRES_PER_DEGREE) / k
    edge_lon = F.lit(margin / METRES_PER_DEGREE) / k
    return (
        (lat > low_lat + margin / METRES_PER_DEGREE)
        & (lat < TOP_LAT - margin / METRES_PER_DEGREE)
        & (lon > F.lit(LEFT_LON) + edge_lon)
        & (lon < high_lon - edge_lon)
    )


def inside_margin(lat, lon, min_lat, min_lon, max_lat, max_lon, share: float = 0.07) -> Column:
    """Strictly inside a region shrunk by ``share`` of its extent on each side."""
    mlat, mlon = share * (max_lat - min_lat), share * (max_lon - min_lon)
    return (lat - min_lat > mlat) & (max_lat - lat > mlat) & (lon - min_lon > mlon) & (max_lon - lon > mlon)


def in_crop(a, b, size: int = 400, margin: int = 24) -> Column:
    return (a > margin) & (a < size - margin) & (b > margin) & (b < size - margin)


def location_key(lat, lon) -> Column:
    return F.format_string("%.7f_%.7f", lat, lon)


def metre_cell(v, size: float) -> Column:
    """Integer cell of a coordinate in degrees; cuts towards zero."""
    return (v * METRES_PER_DEGREE / size).cast("bigint")


def rotate_in_patch(x, y, patch: float, turns: Column) -> tuple[Column, Column]:
    """Quarter turns counter-clockwise (in the image) about the patch centre."""
    px, py = F.lit(patch) - x, F.lit(patch) - y
    rx = F.when(turns == 0, x).when(turns == 1, y).when(turns == 2, px).otherwise(py)
    ry = F.when(turns == 0, y).when(turns == 1, px).when(turns == 2, py).otherwise(x)
    return rx, ry


def rotate_pixel(x, y, size: int, turns: Column) -> tuple[Column, Column]:
    """The same quarter turns for pixel indices of a size x size raster."""
    return rotate_in_patch(x, y, size - 1, turns)


def byte_score(score) -> Column:
    """A 0..1 score as an integer 0..255, fraction cut off."""
    return F.floor(score * 255).cast("int")


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def tie_hash(x, y) -> Column:
    """Integer mix of a position, used to order equal scores without spatial pattern."""
    hx = F.floor(x).cast("bigint") * F.lit(73856093).cast("bigint")
    hy = F.floor(y).cast("bigint") * F.lit(19349663).cast("bigint")
    return F.pmod(hx.bitwiseXOR(hy), F.lit(1000003).cast("bigint"))
