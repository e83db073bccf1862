"""Geometry on (lat, lng) degrees as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0
#: Cells of the grid index are this part of a degree.
CELLS_PER_DEGREE = 1000
MIN_SQUARED_LENGTH = 1e-12


def rad(deg: Column) -> Column:
    return deg * F.pi() / F.lit(180.0)


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres."""
    return arc(squared_chord(lat1, lng1, lat2, lng2, F.cos(rad(lat1))))


def squared_chord(lat1: Column, lng1: Column, lat2: Column, lng2: Column, k: Column) -> Column:
    """The square of half the chord between two points; k: the cosine of the first latitude."""
    return F.pow(F.sin(rad(lat2 - lat1) / 2), 2) + k * F.cos(rad(lat2)) * F.pow(F.sin(rad(lng2 - lng1) / 2), 2)


def arc(h: Column) -> Column:
    """Metres of a squared_chord()."""
    return F.lit(EARTH_M * 2) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Forward azimuth in degrees, in [-180, 180]."""
    d = rad(lng2 - lng1)
    y = F.sin(d) * F.cos(rad(lat2))
    x = F.cos(rad(lat1)) * F.sin(rad(lat2)) - F.sin(rad(lat1)) * F.cos(rad(lat2)) * F.cos(d)
    return F.atan2(y, x) * F.lit(180.0) / F.pi()


def flat_distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Equirectangular distance in metres at the first point's latitude (for drawn lines)."""
    dy = (lat2 - lat1) * METRES_PER_DEGREE
    dx = (lng2 - lng1) * METRES_PER_DEGREE * F.cos(rad(lat1))
    return F.sqrt(dx * dx + dy * dy)


def project_t(plat: Column, plng: Column, alat: Column, alng: Column, blat: Column, blng: Column) -> Column:
    """Where along a-b the point falls, in [0, 1]; 0 for a segment without length."""
    k = F.cos(rad(plat))
    dx, dy = (blng - alng) * k, blat - alat
    px, py = (plng - alng) * k, plat - alat
    return along(px * dx + py * dy, dx * dx + dy * dy)


def along(dot: Column, squared: Column) -> Column:
    """project_t() from the product of both vectors and the segment's squared length."""
    return F.when(squared < MIN_SQUARED_LENGTH, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(dot, squared))))


def project(plat: Column, plng: Column, alat: Column, alng: Column, blat: Column, blng: Column) -> Column:
    """struct(distance, lat, lng, t) of the nearest point of segment a-b."""
    t = project_t(plat, plng, alat, alng, blat, blng)
    lat, lng = alat + t * (blat - alat), alng + t * (blng - alng)
    return F.struct(haversine(plat, plng, lat, lng).alias("distance"), lat.alias("lat"), lng.alias("lng"), t.alias("t"))


def segment_distance(plat: Column, plng: Column, alat: Column, alng: Column, blat: Column, blng: Column) -> Column:
    return project(plat, plng, alat, alng, blat, blng)["distance"]


def polyline_length(coords: Column) -> Column:
    """Length of an array of struct(lat, lng), summed from the left; 0 below two points."""
    steps = F.when(F.size(coords) < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(coords) - 1)))
    return F.aggregate(steps, F.lit(0.0), lambda s, i: s + haversine(F.get(coords, i - 1)["lat"], F.get(coords, i - 1)["lng"], F.get(coords, i)["lat"], F.get(coords, i)["lng"]))


def point_to_line(plat: Column, plng: Column, coords: Column) -> Column:
    """Distance of a point to an array of struct(lat, lng): infinite for none, to the point for one."""
    steps = F.when(F.size(coords) < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(coords) - 1)))
    each = F.transform(steps, lambda i: segment_distance(plat, plng, F.get(coords, i - 1)["lat"], F.get(coords, i - 1)["lng"], F.get(coords, i)["lat"], F.get(coords, i)["lng"]))
    one = haversine(plat, plng, F.get(coords, F.lit(0))["lat"], F.get(coords, F.lit(0))["lng"])
    return F.when(F.size(coords) == 0, F.lit(float("inf"))).when(F.size(coords) == 1, one).otherwise(F.array_min(each))


def cross(ox: Column, oy: Column, ax: Column, ay: Column, bx: Column, by: Column, k: Column) -> Column:
    return (ax - ox) * k * (by - oy) - (ay - oy) * (bx - ox) * k


def segments_cross(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column], d: tuple[Column, Column]) -> Column:
    """Whether a-b and c-d, pairs (lat, lng), cross properly: a touch or an overlap is no crossing."""
    k = F.cos(rad((a[0] + b[0] + c[0] + d[0]) / 4))
    side = lambda o, p, q: cross(o[1], o[0], p[1], p[0], q[1], q[0], k)
    return (side(c, d, a) * side(c, d, b) < 0) & (side(a, b, c) * side(a, b, d) < 0)


def cell(deg: Column) -> Column:
    """Grid cell of a coordinate, towards minus infinity."""
    return F.floor(deg * CELLS_PER_DEGREE).cast("long")


def clear_metres(lat: Column, deg: float) -> Column:
    """What is at least `deg` degrees away from a point in latitude or in longitude is no nearer than this; a thousandth less, for rounding."""
    far = F.least(F.lit(90.0), F.abs(lat) + 2 * deg)
    return F.lit(EARTH_M * (1 - 1e-3)) * F.least(rad(F.lit(deg)), rad(F.lit(deg)) * F.cos(rad(far)))


def cells_of_box(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """All cells of the box around two points, as an array of struct(cell_lat, cell_lng)."""
    lats = F.sequence(cell(F.least(lat1, lat2)), cell(F.greatest(lat1, lat2)))
    lngs = F.sequence(cell(F.least(lng1, lng2)), cell(F.greatest(lng1, lng2)))
    return F.flatten(F.transform(lats, lambda a: F.transform(lngs, lambda b: F.struct(a.alias("cell_lat"), b.alias("cell_lng")))))


def quantise(v: Column, digits: int = 5) -> Column:
    """Round to decimals with ties towards plus infinity."""
    scale = F.lit(float(10**digits))
    return F.floor(v * scale + 0.5).cast("double") / scale


def wrap(deg: Column) -> Column:
    """An angle difference in [-180, 180]."""
    return F.when(deg > 180, deg - 360).when(deg < -180, deg + 360).otherwise(deg)
