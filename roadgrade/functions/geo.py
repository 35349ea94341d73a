"""Geometry and grade expressions: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import EARTH_RADIUS, EPS, M_PER_DEG, REF_DIST, TILE_SIZE


def js_round(x: Column) -> Column:
    """To the nearest whole number, halves up."""
    return F.floor(x + 0.5)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2)
    b = F.sin(F.radians(lon2 - lon1) / 2)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(h))


def bearing_rad(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from the first point to the second, clockwise from north."""
    f1, f2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.atan2(F.sin(dl) * F.cos(f2), F.cos(f1) * F.sin(f2) - F.sin(f1) * F.cos(f2) * F.cos(dl))


def fold_angle(a: Column, b: Column) -> Column:
    """Absolute difference of two bearings, at most pi."""
    x = F.abs(a - b)
    return F.when(x > F.pi(), 2 * F.pi() - x).otherwise(x)


def interior_ref(pts: Column, end: int) -> Column:
    """First vertex REF_DIST metres or more along the way from its start (end 0) or end (end 1); else the far vertex.

    pts: array of structs with lat and lon.
    """
    p = pts if end == 0 else F.reverse(pts)
    step = F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: haversine_m(a["lat"], a["lon"], b["lat"], b["lon"]))
    found = F.aggregate(
        step,
        F.struct(F.lit(0.0).alias("run"), F.lit(0).alias("k")),
        lambda s, x: F.when(s["run"] >= REF_DIST, s).otherwise(F.struct((s["run"] + x).alias("run"), (s["k"] + 1).alias("k"))),
        lambda s: s["k"],
    )
    return F.element_at(p, found + 1)


def end_bearings(pts: Column, end: int) -> Column:
    """(leaving, entering): bearings in which one leaves a way through its start (end 0) or end (1), and enters it there."""
    tip = F.element_at(pts, 1 if end == 0 else -1)
    bearing = lambda a, b: bearing_rad(a["lat"], a["lon"], b["lat"], b["lon"])
    both = lambda ref: F.struct(bearing(ref, tip).alias("leaving"), bearing(tip, ref).alias("entering"))
    # the reference is looked for once, not once for each place of its name
    return F.element_at(F.transform(F.array(interior_ref(pts, end)), both), 1)


def middle_scale(lat1: Column, lat2: Column) -> Column:
    """How long a degree of longitude is in the middle of a segment, in degrees of latitude."""
    return F.cos(F.radians((lat1 + lat2) / 2))


def segment_cross_frac(a: list[Column], b: list[Column], c: list[Column], d: list[Column], k: Column | None = None) -> Column:
    """Where on a-b (0 to 1) segment c-d crosses it inside both; null if it doesn't. Points are (lat, lon); k: the middle
    scale of a-b, if it has been made once for many c-d."""
    k = middle_scale(a[0], b[0]) if k is None else k
    rx, ry = (b[1] - a[1]) * k, b[0] - a[0]
    sx, sy = (d[1] - c[1]) * k, d[0] - c[0]
    qx, qy = (c[1] - a[1]) * k, c[0] - a[0]
    den = rx * sy - ry * sx
    t, u = F.try_divide(qx * sy - qy * sx, den), F.try_divide(qx * ry - qy * rx, den)
    # each quotient is named once, as Java compiles no method of a great many steps; they are null on parallels
    inside = (F.abs(t - 0.5) < 0.5 - EPS) & (F.abs(u - 0.5) < 0.5 - EPS)
    return F.when(inside, t)


def tile_xy(lat: Column, lon: Column, zoom: int) -> Column:
    """Struct x, y (tile) and px, py (pixel within it) of a point in Web Mercator."""
    n = float(2**zoom)
    fx = (lon + 180) / 360 * n
    f = F.radians(lat)
    fy = (1 - F.log(F.tan(f) + 1 / F.cos(f)) / F.pi()) / 2 * n
    x, y = (F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(2**zoom - 1)) for v in (fx, fy))
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), ((fx - x) * TILE_SIZE).alias("px"), ((fy - y) * TILE_SIZE).alias("py"))


def terrarium(r: Column, g: Column, b: Column) -> Column:
    """Metres from the three bytes of a pixel."""
    return r * 256.0 + g + b / 256.0 - 32768.0


def bilinear(raster: Column, px: Column, py: Column, size: int = TILE_SIZE) -> Column:
    """Value at a pixel position within one tile: centres are at halves, and the tile's edge values go on beyond it."""
    top = F.lit(float(size - 1))
    x, y = (F.least(F.greatest(v - 0.5, F.lit(0.0)), top) for v in (px, py))
    x0, y0 = F.floor(x).cast("int"), F.floor(y).cast("int")
    x1, y1 = F.least(x0 + 1, F.lit(size - 1)), F.least(y0 + 1, F.lit(size - 1))
    at = lambda i, j: F.element_at(raster, j * size + i + 1).cast("double")
    fx, fy = x - x0, y - y0
    upper = at(x0, y0) * (1 - fx) + at(x1, y0) * fx
    lower = at(x0, y1) * (1 - fx) + at(x1, y1) * fx
    return upper * (1 - fy) + lower * fy


def node_key(lat: Column, lon: Column) -> Column:
    """One string for equal points at six decimals."""
    return F.format_string("%.6f,%.6f", lat, lon)


def grid_cell(x: Column, cell: float) -> Column:
    return F.floor(x / cell)


def box_cells(lat1: Column, lon1: Column, lat2: Column, lon2: Column, cell: float) -> Column:
    """Array of (cy, cx) of all cells that a segment's box touches; explode it."""
    ys = F.sequence(grid_cell(F.least(lat1, lat2), cell), grid_cell(F.greatest(lat1, lat2), cell))
    xs = F.sequence(grid_cell(F.least(lon1, lon2), cell), grid_cell(F.greatest(lon1, lon2), cell))
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(y.alias("cy"), x.alias("cx")))))


def planar_xy(lat: Column, lon: Column, lat0: Column) -> tuple[Column, Column]:
    """Metres east and north on a plane through latitude lat0."""
    return lon * M_PER_DEG * F.cos(F.radians(lat0)), lat * M_PER_DEG


def segment_distance(py: Column, px: Column, a: list[Column], b: list[Column]) -> Column:
    """Planar distance (in degrees of latitude) from point (py, px) to segment a-b, scaled at the point's latitude."""
    k = F.cos(F.radians(py))
    dx, dy = (b[1] - a[1]) * k, b[0] - a[0]
    qx, qy = (px - a[1]) * k, py - a[0]
    t = F.coalesce(F.try_divide(qx * dx + qy * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    ex, ey = qx - t * dx, qy - t * dy
    return F.sqrt(ex * ex + ey * ey)
