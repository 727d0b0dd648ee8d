"""Geodesic and planar measures as Column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius in metres; metres a degree of latitude and longitude for short local distances.
EARTH_RADIUS_M = 6371008.8
LOCAL_LAT_M, LOCAL_LNG_M = 110540.0, 111320.0
#: Fixed value: the latitude at which the Web Mercator square ends.
MERCATOR_EDGE = 85.05112878
#: Fixed values of the UTM zone 32 projection on GRS80.
UTM_A, UTM_F, UTM_K0, UTM_LON0, UTM_FALSE_EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 9.0, 500000.0


def haversine_square(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """The square of the sine of half the angle between two points: it grows with their distance, and needs no root."""
    return F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres."""
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(haversine_square(lat1, lng1, lat2, lng2)))


def surface_distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """The same, clamped against rounding and right across the antimeridian; null for coordinates out of range."""
    span = F.pmod(lng2 - lng1 + F.lit(540.0), F.lit(360.0)) - 180
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(span) / 2), 2)
    valid = (F.abs(lat1) <= 90) & (F.abs(lat2) <= 90)
    return F.when(valid, 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0)))))


def haversine_atan2(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres by the form that stays exact for antipodes."""
    a = haversine_square(lat1, lng1, lat2, lng2)
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def coordinate_key(lat: Column, lng: Column) -> tuple[Column, Column]:
    """Coordinates in whole 1e-7 degrees, so that joins never compare doubles."""
    return F.round(lat * 1e7).cast("long"), F.round(lng * 1e7).cast("long")


def longitude(x: Column) -> Column:
    """A longitude turned into [-180, 180)."""
    return F.pmod(x + F.lit(180.0), F.lit(360.0)) - 180


def longitude_delta(a: Column, b: Column) -> Column:
    """Degrees from b to a the short way, signed."""
    return longitude(a - b)


def finite(x: Column) -> Column:
    """A number, or null where it is none or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def in_box(lat: Column, lng: Column, box: tuple[float, float, float, float], *, pad: float = 0.0) -> Column:
    """Whether a point lies in (south, west, north, east), edges included, the box wider by a share ``pad`` of its sides; unknown coordinates don't."""
    south, west, north, east = box
    dy, dx = (north - south) * pad, (east - west) * pad
    return F.coalesce(lat.between(south - dy, north + dy) & lng.between(west - dx, east + dx), F.lit(False))


def in_half_open_box(east: Column, north: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a projected point lies in (west, south, east, north), with the west and north edges only, as raster cells do."""
    w, s, e, n = box
    return (east >= w) & (east < e) & (north > s) & (north <= n)


def _turn(a: tuple, b: tuple, c: tuple):
    """Twice the signed area of a triangle of (lat, lng) points."""
    return (b[1] - a[1]) * (c[0] - a[0]) - (b[0] - a[0]) * (c[1] - a[1])


def segments_cross(a: tuple, b: tuple, c: tuple, d: tuple, eps: float = 1e-12) -> Column:
    """Whether the segments a-b and c-d of (lat, lng) columns share a point, ends and overlaps included."""
    turns = [_turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)]
    proper = ((turns[0] > 0) != (turns[1] > 0)) & ((turns[2] > 0) != (turns[3] > 0))
    out = proper
    for turn, (x, y), p in zip(turns, ((a, b), (a, b), (c, d), (c, d)), (c, d, a, b)):
        within = F.lit(True)
        for i in (0, 1):
            within = within & (p[i] >= F.least(x[i], y[i]) - eps) & (p[i] <= F.greatest(x[i], y[i]) + eps)
        out = out | ((F.abs(turn) <= eps) & within)
    return out


def crosses_ring(a: tuple, b: tuple, ring: list[tuple[float, float]]) -> Column:
    """Whether the segment a-b meets an edge of a closed ring."""
    point = lambda p: (F.lit(p[0]), F.lit(p[1]))
    out = F.lit(False)
    for c, d in zip(ring, ring[1:]):
        out = out | segments_cross(a, b, point(c), point(d))
    return out


def walking_minutes(distance_m: Column, ascent_m: Column) -> Column:
    """Whole minutes at 5 km/h and 10 m of ascent a minute, one at least."""
    return F.greatest(F.lit(1), F.bround(distance_m / (5000 / 60) + ascent_m / 10).cast("int"))


def rise_is_sane(low_m: Column, high_m: Column, least: float) -> Column:
    """(rise_m, ok): the climb between two elevations, and whether it is as large as it should be; an unknown one isn't."""
    rise = finite(high_m) - finite(low_m)
    return F.struct(rise.alias("rise_m"), F.coalesce(rise >= least, F.lit(False)).alias("ok"))


def longitude_between(lng: Column, west: Column, east: Column) -> Column:
    """Whether a longitude lies in bounds that may cross the antimeridian."""
    west, east, lng = longitude(west), longitude(east), longitude(lng)
    return F.when(west <= east, lng.between(west, east)).otherwise((lng >= west) | (lng <= east))


def segment_distance(lat: Column, lng: Column, a_lat: float, a_lng: float, b_lat: float, b_lng: float) -> Column:
    """Metres from a point to a short segment, on a local plane around the point."""
    east = F.cos(F.radians(lat)) * LOCAL_LNG_M
    ax, ay = (F.lit(a_lng) - lng) * east, (F.lit(a_lat) - lat) * LOCAL_LAT_M
    bx, by = (F.lit(b_lng) - lng) * east, (F.lit(b_lat) - lat) * LOCAL_LAT_M
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.least(F.greatest(-(ax * dx + ay * dy) / square, F.lit(0.0)), F.lit(1.0)))
    return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))


def ring_distance(lat: Column, lng: Column, ring: list[tuple[float, float]]) -> Column:
    """Metres to the nearest edge of a closed ring of (lat, lng)."""
    return F.least(*(segment_distance(lat, lng, *a, *b) for a, b in zip(ring, ring[1:])))


def in_ring(lat: Column, lng: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a closed ring: an odd number of edges is crossed by the ray east."""
    crossings = F.lit(0)
    for (a_lat, a_lng), (b_lat, b_lng) in zip(ring, ring[1:]):
        if a_lat == b_lat:
            continue
        spans = (F.lit(a_lat) > lat) != (F.lit(b_lat) > lat)
        at = F.lit(b_lng - a_lng) * (lat - F.lit(a_lat)) / F.lit(b_lat - a_lat) + F.lit(a_lng)
        crossings = crossings + F.when(spans & (lng < at), 1).otherwise(0)
    return crossings % 2 == 1


def _third_flattening() -> float:
    return UTM_F / (2 - UTM_F)


def _series(*terms: tuple[float, ...]) -> list[float]:
    """Values of polynomials in the third flattening, given their coefficients from the first power on."""
    n = _third_flattening()
    return [sum(c * n ** (i + 1) for i, c in enumerate(t)) for t in terms]


#: The Krueger series of the transverse Mercator projection to the fourth power of the third flattening.
_FORWARD = _series((1 / 2, -2 / 3, 5 / 16, 41 / 180), (0, 13 / 48, -3 / 5, 557 / 1440), (0, 0, 61 / 240, -103 / 140), (0, 0, 0, 49561 / 161280))
_BACK = _series((1 / 2, -2 / 3, 37 / 96, -1 / 360), (0, 1 / 48, 1 / 15, -437 / 1440), (0, 0, 17 / 480, -37 / 840), (0, 0, 0, 4397 / 161280))
_LATITUDE = _series((2, -2 / 3, -2, 116 / 45), (0, 7 / 3, -8 / 5, -227 / 45), (0, 0, 56 / 15, -136 / 35), (0, 0, 0, 4279 / 630))
_N = _third_flattening()
#: The rectifying radius times the central scale.
UTM_RADIUS = UTM_K0 * UTM_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)


def utm32(lat: Column, lng: Column) -> tuple[Column, Column]:
    """(easting, northing) in zone 32."""
    phi, lam = F.radians(lat), F.radians(lng - UTM_LON0)
    q = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - q * F.atanh(q * F.sin(phi)))
    xi, eta = F.atan(t / F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_FORWARD, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return UTM_FALSE_EASTING + UTM_RADIUS * east, UTM_RADIUS * north


def utm32_inverse(east: Column, north: Column) -> tuple[Column, Column]:
    """(lat, lng) of zone 32 coordinates."""
    xi, eta = north / UTM_RADIUS, (east - UTM_FALSE_EASTING) / UTM_RADIUS
    x, y = xi, eta
    for j, b in enumerate(_BACK, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    phi = chi
    for j, d in enumerate(_LATITUDE, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(phi), UTM_LON0 + F.degrees(F.atan(F.sinh(y) / F.cos(x)))


def box_corners(west: Column, south: Column, east: Column, north: Column, project) -> Column:
    """The four corners of a box through ``project`` (a function of two columns), as an array of (x, y)."""
    return F.array(*(F.struct(*(c.alias(n) for c, n in zip(project(y, x), ("x", "y")))) for y in (south, north) for x in (west, east)))


def tile_fraction(lat: Column, lng: Column, zoom: Column) -> tuple[Column, Column]:
    """Where a point lies in the Web Mercator tiles of a zoom; latitudes beyond the projection's edge count as that edge."""
    n = F.pow(F.lit(2.0), zoom)
    edge = F.least(F.greatest(lat, F.lit(-MERCATOR_EDGE)), F.lit(MERCATOR_EDGE))
    y = (1 - F.ln(F.tan(F.radians(edge)) + 1 / F.cos(F.radians(edge))) / math.pi) / 2 * n
    return (lng + 180) / 360 * n, y


def tile_xy(lat: Column, lng: Column, zoom: int) -> tuple[Column, Column]:
    """Web Mercator tile that holds a point."""
    x, y = tile_fraction(lat, lng, F.lit(zoom))
    return F.floor(x).cast("long"), F.floor(y).cast("long")


def pixel_center(zoom: Column, x: Column, y: Column, column: Column, row: Column, size: int = 256) -> tuple[Column, Column]:
    """(lat, lng) of the centre of a tile's pixel."""
    n = F.pow(F.lit(2.0), zoom)
    east, south = (x + (column + 0.5) / size) / n, (y + (row + 0.5) / size) / n
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * south)))), east * 360 - 180


def terrarium(z: Column) -> tuple[Column, Column, Column]:
    """An elevation as red, green and blue: offset 32768, quantum 1/256. Elevations that three bytes can't hold fail."""
    q = F.rint((z + 32768) * 256).cast("long")
    q = F.when(q.between(0, (1 << 24) - 1), q).otherwise(F.when(q.isNotNull(), F.raise_error(F.lit("elevation outside the encoding's range")).cast("long")))
    return F.shiftright(q, 16), F.shiftright(q, 8).bitwiseAND(F.lit(255)), q.bitwiseAND(F.lit(255))


def from_terrarium(r: Column, g: Column, b: Column) -> Column:
    return (r * 65536 + g * 256 + b) / F.lit(256.0) - 32768
