"""Geometry as Column expressions: everything here stays inside Catalyst. Coordinates are latitude and longitude in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the operators: mean earth radius, the rounder one of the CSV statistics, metres per degree, half of the Mercator square.
EARTH_M = 6371008.7714
EARTH_CSV_M = 6371000.0
DEGREE_M = 111111.0
HALF_CIRCLE = 20037508.34
#: What angle_distance gives where a direction has no length, and how it must be told from real distances.
NO_ANGLE = 100000.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also within higher-order functions, where common parts are not shared."""
    return F.element_at(F.transform(F.array(value), body), 1)


def haversine_m(lat1, lng1, lat2, lng2, radius: float = EARTH_M) -> Column:
    """Great-circle distance; exactly 0 for equal coordinates."""
    lat1, lng1, lat2, lng2 = map(_c, (lat1, lng1, lat2, lng2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.when((lat1 == lat2) & (lng1 == lng2), 0.0).otherwise(2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a)))


def degree_distance(lat1, lng1, lat2, lng2) -> Column:
    """Equirectangular distance in degrees, longitude scaled at the first point: not symmetric."""
    return F.sqrt(F.pow(_c(lat1) - lat2, 2) + F.pow((_c(lng1) - lng2) * F.cos(F.radians(_c(lat1))), 2))


def planar_m(lat1, lng1, lat2, lng2) -> Column:
    """Equirectangular distance in metres."""
    return degree_distance(lat1, lng1, lat2, lng2) * DEGREE_M


def bearing(lat1, lng1, lat2, lng2) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    p, q, d = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lng2) - _c(lng1))
    return (F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))) + 360) % 360


def interpolate(lat1, lng1, lat2, lng2, rate) -> tuple[Column, Column]:
    return _c(lat1) + rate * (_c(lat2) - _c(lat1)), _c(lng1) + rate * (_c(lng2) - _c(lng1))


def project(lat1, lng1, lat2, lng2, lat, lng, to_line: bool = False) -> Column:
    """struct(lat, lng, rate, dist): the foot of a point on the segment from 1 to 2, or on its line."""
    lat1, lng1, lat2, lng2, lat, lng = map(_c, (lat1, lng1, lat2, lng2, lat, lng))
    length = haversine_m(lat1, lng1, lat2, lng2)
    along = haversine_m(lat1, lng1, lat, lng) * F.cos(F.radians(bearing(lat1, lng1, lat, lng) - bearing(lat1, lng1, lat2, lng2)))

    def foot(rate: Column) -> Column:
        y, x = interpolate(lat1, lng1, lat2, lng2, rate)
        if not to_line:  # the ends are exact
            y = F.when(rate >= 1, lat2).when(rate <= 0, lat1).otherwise(y)
            x = F.when(rate >= 1, lng2).when(rate <= 0, lng1).otherwise(x)
        return F.struct(y.alias("lat"), x.alias("lng"), rate.alias("rate"))

    def measured(p: Column) -> Column:
        return F.struct(p["lat"].alias("lat"), p["lng"].alias("lng"), p["rate"].alias("rate"), haversine_m(lat, lng, p["lat"], p["lng"]).alias("dist"))

    rate = let(F.struct(length.alias("length"), along.alias("along")), lambda m: F.when(m["length"] == 0, 0.0).otherwise(m["along"] / m["length"]))
    if not to_line:
        rate = F.greatest(F.lit(0.0), F.least(F.lit(1.0), rate))
    return let(let(rate, foot), measured)


def nearest_on_polyline(coords: Column, lat, lng) -> Column:
    """struct(dist, i, rate, lat, lng) of the nearest segment of an array of struct(lat, lng); of equal ones the first."""

    def foot(i):
        a, b = F.element_at(coords, i), F.element_at(coords, i + 1)
        return project(a["lat"], a["lng"], b["lat"], b["lng"], lat, lng)

    feet = F.transform(F.sequence(F.lit(1), F.size(coords) - 1), foot)
    return F.array_min(F.transform(feet, lambda p, i: F.struct(p["dist"].alias("dist"), i.alias("i"), p["rate"].alias("rate"), p["lat"].alias("lat"), p["lng"].alias("lng"))))


def length_m(coords: Column) -> Column:
    """Length of an array of struct(lat, lng)."""
    hops = F.zip_with(F.slice(coords, 1, F.size(coords) - 1), F.slice(coords, 2, F.size(coords) - 1), lambda a, b: haversine_m(a["lat"], a["lng"], b["lat"], b["lng"]))
    return F.when(F.size(coords) < 2, 0.0).otherwise(F.aggregate(hops, F.lit(0.0), lambda s, x: s + x))


def included_angle(alat, alng, blat, blng, clat, clng, dlat, dlng) -> Column:
    """Angle between a-b and c-d in whole degrees; both directions are cut to whole degrees first."""
    way = lambda y1, x1, y2, x2: F.degrees(F.atan2(_c(y2) - y1, _c(x2) - x1)).cast("int")
    p, q = way(alat, alng, blat, blng), way(clat, clng, dlat, dlng)
    wide = F.abs(p) + F.abs(q)
    return F.when(p * q >= 0, F.abs(p - q)).otherwise(F.when(wide > 180, 360 - wide).otherwise(wide))


def within_m(lat, lng, at_lat: float, at_lng: float, metres: float) -> Column:
    """Whether a place lies within so many metres of a given one. A box around it, which the scan can use, goes before the
    distance and never decides otherwise."""
    up = metres / 110_000.0
    side = up / math.cos(math.radians(min(abs(at_lat) + up, 89.9)))
    near = _c(lat).between(at_lat - up, at_lat + up)
    if abs(at_lng) + side < 180 and abs(at_lat) + up < 89.9:
        near = near & _c(lng).between(at_lng - side, at_lng + side)
    return near & (haversine_m(lat, lng, at_lat, at_lng) <= metres)


def point_to_segment_degrees(lat1, lng1, lat2, lng2, lat, lng) -> Column:
    """Planar distance in degrees of a point to a segment, longitudes scaled at its first end."""
    k = F.cos(F.radians(_c(lat1)))
    y2, x2, y, x = _c(lat2) - lat1, (_c(lng2) - lng1) * k, _c(lat) - lat1, (_c(lng) - lng1) * k
    length = F.sqrt(y2 * y2 + x2 * x2)
    along = F.when(length > 0, (y2 * y + x2 * x) / length).otherwise(0.0)
    rate = F.when(length > 0, along / length).otherwise(0.0)
    own = lambda u, v: F.sqrt(F.pow(y - u, 2) + F.pow(x - v, 2))
    return F.when(along > length, own(y2, x2)).when(along < 0, own(F.lit(0.0), F.lit(0.0))).otherwise(own(rate * y2, rate * x2))


def unit_direction(dlat, dlng, at: float = 40.0) -> tuple[Column, Column]:
    x = _c(dlng) * math.cos(math.radians(at))
    n = F.sqrt(x * x + _c(dlat) * _c(dlat))
    return F.when(n > 0, _c(dlat) / n), F.when(n > 0, x / n)


def angle_distance(y1, x1, y2, x2) -> Column:
    """Distance of two directions on the unit circle; NO_ANGLE if either has no length."""
    p, q = F.sqrt(_c(y1) * y1 + _c(x1) * x1), F.sqrt(_c(y2) * y2 + _c(x2) * x2)
    return F.when((p == 0) | (q == 0), NO_ANGLE).otherwise(F.sqrt(F.pow(_c(y1) / p - _c(y2) / q, 2) + F.pow(_c(x1) / p - _c(x2) / q, 2)))


def ray_edge(base_x, base_y, dx, dy, ax, ay, bx, by) -> Column:
    """struct(x, y, extend, hit): where a ray meets an edge; zeros if parallel, behind or outside."""
    t = dx * ay + dy * bx - dx * by - dy * ax
    c = bx * ay - ax * by + base_x * (by - ay) + base_y * (ax - bx)
    alpha = F.when(t != 0, c / t)
    x, y = base_x + alpha * dx, base_y + alpha * dy
    hit = F.coalesce((alpha >= 0) & ((x - ax) * (bx - x) + (y - ay) * (by - y) >= 0), F.lit(False))
    zero = F.lit(0.0)
    pick = lambda v: F.when(hit, v).otherwise(zero)
    return F.struct(pick(x).alias("x"), pick(y).alias("y"), pick(F.sqrt(F.pow(alpha * dx, 2) + F.pow(alpha * dy, 2))).alias("extend"), hit.cast("int").alias("hit"))


def hausdorff_m(a: Column, b: Column) -> Column:
    """Symmetric Hausdorff distance of two arrays of struct(lat, lng)."""
    one = lambda p, q: F.array_max(F.transform(p, lambda u: F.array_min(F.transform(q, lambda v: haversine_m(u["lat"], u["lng"], v["lat"], v["lng"])))))
    return F.greatest(one(a, b), one(b, a))


def wkt_line(coords: Column, digits: int = 7) -> Column:
    """LINESTRING text, longitude first."""
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(coords, lambda p: F.format_string(f"%.{digits}f %.{digits}f", p["lng"], p["lat"])), ", "), F.lit(")"))


def wkt_box(min_lat, min_lng, max_lat, max_lng, digits: int = 7) -> Column:
    corner = lambda x, y: F.format_string(f"%.{digits}f %.{digits}f", x, y)
    ring = [(min_lng, min_lat), (min_lng, max_lat), (max_lng, max_lat), (max_lng, min_lat), (min_lng, min_lat)]
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *[corner(x, y) for x, y in ring]), F.lit("))"))


def parse_wkt_line(wkt: Column) -> Column:
    """Array of struct(lat, lng); null for anything that is not a LINESTRING of numbers."""
    inner = F.regexp_extract(wkt, r"^\s*LINESTRING\s*\(([-+0-9.eE, ]+)\)\s*$", 1)
    points = F.transform(F.split(F.trim(inner), r"\s*,\s*"), lambda p: F.split(F.trim(p), r"\s+"))
    return F.when(inner != "", F.transform(points, lambda p: F.struct(F.try_element_at(p, F.lit(2)).try_cast("double").alias("lat"), F.try_element_at(p, F.lit(1)).try_cast("double").alias("lng"))))


def in_box(lat, lng, min_lat, min_lng, max_lat, max_lng) -> Column:
    """Half-open containment."""
    return (_c(lat) >= min_lat) & (_c(lat) < max_lat) & (_c(lng) >= min_lng) & (_c(lng) < max_lng)


def in_bound_with_margin(lat, lng, size_m: float, margin_m: float, lat0: float = 41.0, lng0: float = -71.0) -> Column:
    """Strictly inside a square that lies north-west of an anchor, shrunk by a margin."""
    y = (_c(lat) - lat0) * DEGREE_M
    x = (_c(lng) - lng0) * DEGREE_M * math.cos(math.radians(lat0))
    return (y > margin_m) & (y < size_m - margin_m) & (x > margin_m) & (x < size_m - margin_m)


def to_mercator(lat, lng) -> tuple[Column, Column]:
    """x, y in metres."""
    y = F.ln(F.tan((90.0 + _c(lat)) * math.pi / 360.0)) / (math.pi / 180.0)
    return _c(lng) * HALF_CIRCLE / 180.0, y * HALF_CIRCLE / 180.0


def from_mercator(x, y) -> tuple[Column, Column]:
    """lat, lng."""
    return F.atan(F.exp(_c(y) / HALF_CIRCLE * math.pi)) * 360.0 / math.pi - 90.0, _c(x) / HALF_CIRCLE * 180.0


def _mercator(lat: float, lng: float) -> tuple[float, float]:
    return lng * HALF_CIRCLE / 180.0, math.log(math.tan((90.0 + lat) * math.pi / 360.0)) / (math.pi / 180.0) * HALF_CIRCLE / 180.0


def geo_to_pixel(lat, lng, box: tuple[float, float, float, float], width: int, height: int, whole: bool = False) -> tuple[Column, Column]:
    """Pixel column and row on a Mercator image of box (min_lat, min_lng, max_lat, max_lng); whole cuts to integers."""
    (x0, y0), (x1, y1) = _mercator(box[0], box[1]), _mercator(box[2], box[3])
    x, y = to_mercator(lat, lng)
    px, py = (x - x0) / (x1 - x0) * width, (y1 - y) / (y1 - y0) * height
    return (px.cast("int"), py.cast("int")) if whole else (px, py)


def pixel_to_geo(px, py, box: tuple[float, float, float, float], width: int, height: int) -> tuple[Column, Column]:
    (x0, y0), (x1, y1) = _mercator(box[0], box[1]), _mercator(box[2], box[3])
    return from_mercator(_c(px) / width * (x1 - x0) + x0, y1 - _c(py) / height * (y1 - y0))


def region_grid(box: tuple[float, float, float, float], size: int) -> tuple[float, float, int, int]:
    """Tile height and width in degrees and the number of rows and columns of a tiling by squares of size metres."""
    dlat, dlng = size / DEGREE_M, size / (DEGREE_M * math.cos(math.radians(box[0])))
    return dlat, dlng, math.ceil((box[2] - box[0]) / dlat), math.ceil((box[3] - box[1]) / dlng)


def region_box(region: Column, box: tuple[float, float, float, float], size: int, origin: str = "nw") -> Column:
    """struct(min_lat, max_lat, min_lng, max_lng) of a tile, numbered by rows from the north-west or south-west corner."""
    dlat, dlng, _, columns = region_grid(box, size)
    i, j = F.floor(region / columns), region % columns
    north = box[2] - i * dlat
    lo, hi = (box[2] - (i + 1) * dlat, north) if origin == "nw" else (F.round(box[0] + i * dlat, 7), F.round(box[0] + (i + 1) * dlat, 7))
    west = box[1] + j * dlng
    east = west + dlng
    if origin == "sw":
        west, east = F.round(west, 7), F.round(east, 7)
    return F.struct(lo.alias("min_lat"), hi.alias("max_lat"), west.alias("min_lng"), east.alias("max_lng"))


def rc_to_geo(row, col, b: Column, size: int) -> tuple[Column, Column]:
    return b["max_lat"] - row / size * (b["max_lat"] - b["min_lat"]), b["min_lng"] + col / size * (b["max_lng"] - b["min_lng"])


def geo_to_rc(lat, lng, b: Column, size: int) -> tuple[Column, Column]:
    return (b["max_lat"] - lat) / (b["max_lat"] - b["min_lat"]) * size, (lng - b["min_lng"]) / (b["max_lng"] - b["min_lng"]) * size


def render_pixel(lat, lng, box: tuple[float, float, float, float], size_x: int, size_y: int) -> tuple[Column, Column]:
    """Row from the bottom and column, cut to integers."""
    return size_x - ((_c(lat) - box[0]) / ((box[2] - box[0]) / size_x)).cast("int"), ((_c(lng) - box[1]) / ((box[3] - box[1]) / size_y)).cast("int")


def location_key(lat, lng) -> Column:
    return F.format_string("%.7f_%.7f", _c(lat), _c(lng))


def cell_key(lat, lng, metres: float) -> tuple[Column, Column]:
    """Whole cells of so many metres, cut towards zero."""
    return (_c(lat) * DEGREE_M / metres).cast("bigint"), (_c(lng) * DEGREE_M / metres).cast("bigint")
