"""Geodesy on the sphere, boxes, tiles and projections, as Column expressions: all of them stay in the JVM.

Angles are degrees, lengths metres. A box is a struct<min_lat, min_lon, max_lat, max_lon>.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the sphere's radius.
EARTH_RADIUS = 6371010.0
#: Fixed value: coordinates are stored in steps of 1/MAX_RAW of the range of latitudes or longitudes (27 bits).
MAX_RAW = 0x7FFFFFF
#: Names of zoom levels.
MAGNIFICATIONS = {
    "world": 0, "continent": 4, "state": 5, "stateOver": 6, "county": 7, "region": 8, "proximity": 9, "cityOver": 10, "city": 11,
    "suburb": 12, "detail": 13, "close": 14, "closer": 15, "veryClose": 16, "block": 18, "street": 19, "house": 20,
}


def spherical_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the great circle (haversine)."""
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return 2 * EARTH_RADIUS * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def haversine_metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """spherical_distance of plain numbers, for folds."""
    a, b = math.sin(math.radians(lat2 - lat1) / 2), math.sin(math.radians(lon2 - lon1) / 2)
    h = a * a + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * b * b
    return 2 * EARTH_RADIUS * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def initial_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Direction at the first point towards the second, from 0 (north) clockwise below 360."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    turned = F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)))
    return normalize_bearing(turned)


def final_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Direction at the second point, coming from the first."""
    return normalize_bearing(initial_bearing(lat2, lon2, lat1, lon1) + 180)


def normalize_bearing(degrees: Column) -> Column:
    return degrees - 360 * F.floor(degrees / 360)


def relative_angle(degrees: Column) -> Column:
    """The same angle within (-180, 180]."""
    around = normalize_bearing(degrees)
    return F.when(around > 180, around - 360).otherwise(around)


def angle_difference(a: Column, b: Column) -> Column:
    """Unsigned, 180 at most."""
    return F.abs(relative_angle(a - b))


def lon_degrees(metres: Column, lat: Column) -> Column:
    """How many degrees of longitude a length spans at a latitude."""
    return metres / (F.lit(2 * math.pi * EARTH_RADIUS) * F.cos(F.radians(lat)) / 360)


def compass_point(bearing: Column) -> Column:
    """N, E, S or W; whole degrees up to 45 are north."""
    b = F.round(bearing)
    return F.when(bearing.isNull() | F.isnan(bearing), "?").when(b <= 45, "N").when(b <= 135, "E").when(b <= 225, "S").when(b <= 315, "W").otherwise("N")


def compass_point_long(bearing: Column) -> Column:
    """One of eight points. The bounds."""
    found = F.when(bearing.isNull() | F.isnan(bearing), "?")
    for bound, name in ((12.5, "N"), (57.5, "NE"), (102.5, "E"), (147.5, "SE"), (192.5, "S"), (237.5, "SW"), (282.5, "W"), (327.5, "NW")):
        found = found.when(bearing <= bound, name)
    return found.otherwise("N")


# ---- boxes


def box(min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column) -> Column:
    return F.struct(min_lat.alias("min_lat"), min_lon.alias("min_lon"), max_lat.alias("max_lat"), max_lon.alias("max_lon"))


def box_of_points(points: Column) -> Column:
    """The box around an array of struct<lat, lon>."""
    lat, lon = F.transform(points, lambda p: p["lat"]), F.transform(points, lambda p: p["lon"])
    return box(F.array_min(lat), F.array_min(lon), F.array_max(lat), F.array_max(lon))


def box_around(lat: Column, lon: Column, radius: Column) -> Column:
    """The smallest box that holds the whole circle on the sphere."""
    up = F.degrees(radius / EARTH_RADIUS)
    wide = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(radius / EARTH_RADIUS) / F.cos(F.radians(lat)))))
    return box(lat - up, lon - wide, lat + up, lon + wide)


def box_within(lat: Column, lon: Column, radius: Column) -> Column:
    """The box whose north-west and south-east corners lie on the circle: it is inscribed, so the circle's own outermost parts are not in it."""
    a = radius / EARTH_RADIUS
    p = F.radians(lat)

    def corner(bearing: float) -> tuple[Column, Column]:
        b = math.radians(bearing)
        end = F.asin(F.sin(p) * F.cos(a) + F.cos(p) * F.sin(a) * math.cos(b))
        side = F.atan2(F.lit(math.sin(b)) * F.sin(a) * F.cos(p), F.cos(a) - F.sin(p) * F.sin(end))
        return F.degrees(end), lon + F.degrees(side)

    (top, left), (bottom, right) = corner(315.0), corner(135.0)
    return box(bottom, left, top, right)


def in_box(lat: Column, lon: Column, b: Column, closed: bool = True) -> Column:
    """Whether the box holds the point; a half-open box excludes its upper bounds."""
    if closed:
        return (lat >= b["min_lat"]) & (lat <= b["max_lat"]) & (lon >= b["min_lon"]) & (lon <= b["max_lon"])
    return (lat >= b["min_lat"]) & (lat < b["max_lat"]) & (lon >= b["min_lon"]) & (lon < b["max_lon"])


def boxes_meet(a: Column, b: Column, closed: bool = True) -> Column:
    """Whether two boxes share a point; half-open ones don't by an edge alone."""
    if closed:
        return (a["min_lat"] <= b["max_lat"]) & (a["max_lat"] >= b["min_lat"]) & (a["min_lon"] <= b["max_lon"]) & (a["max_lon"] >= b["min_lon"])
    return (a["min_lat"] < b["max_lat"]) & (a["max_lat"] > b["min_lat"]) & (a["min_lon"] < b["max_lon"]) & (a["max_lon"] > b["min_lon"])


def box_and(a: Column, b: Column) -> Column:
    """What two boxes share; null if nothing."""
    shared = box(F.greatest(a["min_lat"], b["min_lat"]), F.greatest(a["min_lon"], b["min_lon"]), F.least(a["max_lat"], b["max_lat"]), F.least(a["max_lon"], b["max_lon"]))
    return F.when(boxes_meet(a, b), shared)


def box_or(a: Column, b: Column) -> Column:
    """The smallest box around both."""
    return box(F.least(a["min_lat"], b["min_lat"]), F.least(a["min_lon"], b["min_lon"]), F.greatest(a["max_lat"], b["max_lat"]), F.greatest(a["max_lon"], b["max_lon"]))


def box_centre(b: Column) -> Column:
    return F.struct(((b["min_lat"] + b["max_lat"]) / 2).alias("lat"), ((b["min_lon"] + b["max_lon"]) / 2).alias("lon"))


def box_size(b: Column) -> Column:
    """Height times width in square degrees."""
    return (b["max_lat"] - b["min_lat"]) * (b["max_lon"] - b["min_lon"])


def box_strips(b: Column, n: int) -> Column:
    """The box cut into n strips of one width, west to east."""
    width = (b["max_lon"] - b["min_lon"]) / n
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: box(b["min_lat"], b["min_lon"] + k * width, b["max_lat"], b["min_lon"] + (k + 1) * width))


# ---- coordinates as numbers and text


def raw_lat(lat: Column) -> Column:
    return F.round((lat + 90) * (MAX_RAW / 180.0)).cast("long")


def raw_lon(lon: Column) -> Column:
    return F.round((lon + 180) * (MAX_RAW / 360.0)).cast("long")


def from_raw(lat: Column, lon: Column) -> Column:
    return F.struct((lat * (180.0 / MAX_RAW) - 90).alias("lat"), (lon * (360.0 / MAX_RAW) - 180).alias("lon"))


def point_id(lat: Column, lon: Column) -> Column:
    """One number for a coordinate: the bytes of latitude and longitude interleaved, longitude lowest."""
    y, x = raw_lat(lat), raw_lon(lon)
    total = F.lit(0).cast("long")
    for byte in range(3):
        total = total + F.shiftleft(y.bitwiseAND(F.lit(0xFF << 8 * byte).cast("long")), 8 * (byte + 1)) + F.shiftleft(x.bitwiseAND(F.lit(0xFF << 8 * byte).cast("long")), 8 * byte)
    # Of the highest byte only three bits are in use, so latitude follows longitude after three.
    return total + F.shiftleft(y.bitwiseAND(F.lit(0x07000000).cast("long")), 27) + F.shiftleft(x.bitwiseAND(F.lit(0x07000000).cast("long")), 24)


def point_text(lat: Column, lon: Column) -> Column:
    """Such as 51.57231 N 7.46418 E."""
    side = lambda v, plus, minus: F.concat_ws(" ", F.format_string("%.5f", F.abs(v)), F.when(v >= 0, plus).otherwise(minus))
    return F.concat_ws(" ", side(lat, "N", "S"), side(lon, "E", "W"))


_SIGN = r"\s*([NSEW+-]?)\s*"
#: Degrees with minutes and seconds behind a degree sign; a comma may stand for the point; what a degree sign follows is the next coordinate.
_NUMBER = r"(\d{1,3}+(?:[.,]\d*+)?+)(?:°\s*(?:(\d{1,2}+(?:[.,]\d*+)?+)(?!\s*°)(?:'(?:(\d{1,2}+(?:[.,]\d*+)?+)\")?)?)?)?"
_POINT = rf"^{_SIGN}{_NUMBER}\s*([NS]?)\s*,?{_SIGN}{_NUMBER}\s*([EW]?)\s*$"


def parse_point(text: Column) -> Column:
    """struct<lat, lon> of texts such as 'N 51.5 E 7.4', '51.5 N, 7.4 E', "N 51° 34' E 7° 27'", '-51,5 7,4'; null for others and outside the globe."""
    part = lambda k: F.regexp_extract(text, _POINT, k)
    number = lambda k: F.coalesce(F.replace(part(k), F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))

    def side(k: int, plus: str, minus: str, most: float) -> Column:
        before, after = part(k), part(k + 4)
        ok = before.isin("", "+", "-", plus, minus) & ((before == "") | (after == ""))
        size = number(k + 1) + number(k + 2) / 60 + number(k + 3) / 3600
        return F.when(ok & (size <= most), F.when(before.isin("-", minus) | (after == minus), -size).otherwise(size))

    lat, lon = side(1, "N", "S", 90.0), side(6, "E", "W", 180.0)
    return F.when(F.regexp_like(text, F.lit(_POINT)) & lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


# ---- tiles


def tile(lat: Column, lon: Column, level: Column | int) -> Column:
    """struct<x, y> of the plate carrée grid of 2^level by 2^level cells, from south-west."""
    n = F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level)
    return F.struct(F.floor((lon + 180) / (360 / n)).cast("long").alias("x"), F.floor((lat + 90) / (180 / n)).cast("long").alias("y"))


def tile_box(x: Column, y: Column, level: int) -> Column:
    w, h = 360 / 2.0**level, 180 / 2.0**level
    return box(y * h - 90, x * w - 180, (y + 1) * h - 90, (x + 1) * w - 180)


def tile_parent(x: Column, y: Column, levels: int = 1) -> Column:
    return F.struct(F.shiftright(x, levels).alias("x"), F.shiftright(y, levels).alias("y"))


def tiles_of_box(b: Column, level: int) -> Column:
    """Array of struct<x, y>: all tiles that the box touches."""
    low, high = tile(b["min_lat"], b["min_lon"], level), tile(b["max_lat"], b["max_lon"], level)
    return F.flatten(F.transform(F.sequence(low["x"], high["x"]), lambda x: F.transform(F.sequence(low["y"], high["y"]), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def web_tile(lat: Column, lon: Column, zoom: int) -> Column:
    """struct<x, y> of the web Mercator grid, from north-west."""
    n = float(1 << zoom)
    p = F.radians(lat)
    return F.struct(F.floor((lon + 180) / 360 * n).cast("long").alias("x"), F.floor((1 - F.ln(F.tan(p) + 1 / F.cos(p)) / math.pi) / 2 * n).cast("long").alias("y"))


def web_tile_corner(x: Column, y: Column, zoom: int) -> Column:
    """struct<lat, lon> of a web tile's north-west corner."""
    n = float(1 << zoom)
    return F.struct(F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / n)))).alias("lat"), (x / n * 360 - 180).alias("lon"))


def z_order(x: Column, y: Column, bits: int = 20) -> Column:
    """The bits of two numbers interleaved: near tiles get near keys, so that sorted files hold whole neighbourhoods."""
    total = F.lit(0).cast("long")
    for k in range(bits):
        bit = F.lit(1 << k).cast("long")
        total = total + F.shiftleft(x.bitwiseAND(bit), k) + F.shiftleft(y.bitwiseAND(bit), k + 1)
    return total


def magnification_level(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for kv in MAGNIFICATIONS.items() for v in kv]), name)


# ---- projections


def mercator_pixel(lat: Column, lon: Column, zoom: int, tile_pixels: int = 256) -> Column:
    """struct<x, y> in pixels of the whole world at a zoom level, from north-west."""
    size = float(tile_pixels << zoom)
    p = F.radians(lat)
    return F.struct(((lon + 180) / 360 * size).alias("x"), ((1 - F.ln(F.tan(p) + 1 / F.cos(p)) / math.pi) / 2 * size).alias("y"))


def mercator_point(x: Column, y: Column, zoom: int, tile_pixels: int = 256) -> Column:
    """The inverse of mercator_pixel."""
    size = float(tile_pixels << zoom)
    return F.struct(F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / size)))).alias("lat"), (x / size * 360 - 180).alias("lon"))


def rotated(x: Column, y: Column, centre_x: Column, centre_y: Column, degrees: float) -> Column:
    """A pixel turned around a centre, clockwise."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    dx, dy = x - centre_x, y - centre_y
    return F.struct((centre_x + dx * c - dy * s).alias("x"), (centre_y + dx * s + dy * c).alias("y"))


#: Metres of a unit, and its sign.
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "yd": 0.9144, "mi": 1609.344}


def in_unit(metres: Column, unit: str) -> Column:
    return metres / UNITS[unit]


def to_metres(value: Column, unit: str) -> Column:
    return value * UNITS[unit]


def distance_text(metres: Column) -> Column:
    """With six digits, in metres below 1500 and in kilometres from there on."""
    return F.when(F.abs(metres) < 1500, F.format_string("%.6f m", metres)).otherwise(F.format_string("%.6f km", metres / 1000.0))
