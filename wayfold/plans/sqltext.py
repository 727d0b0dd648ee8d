"""SQL fragments in DuckDB's dialect that several queries' counterparts share."""

from __future__ import annotations

from wayfold.plans import bindings as B

RADIUS = "6371008.8"


def distance(a: str, b: str) -> str:
    """Great-circle metres between the lat and lng of two aliases."""
    return f"2 * {RADIUS} * asin(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lng - {a}.lng) / 2), 2)))"


def in_ring(lat: str, lng: str, ring: list = B.RING) -> str:
    cross = [f"case when (({ay}e0 > {lat}) <> ({by}e0 > {lat})) and {lng} < ({bx - ax!r}::double) * ({lat} - {ay}e0) / ({by - ay!r}::double) + {ax}e0 then 1 else 0 end" for (ay, ax), (by, bx) in zip(ring, ring[1:])]
    return f"(({' + '.join(cross)}) % 2 = 1)"


def ring_distance(lat: str, lng: str, ring: list = B.RING) -> str:
    near = []
    for (ay, ax), (by, bx) in zip(ring, ring[1:]):
        e = f"cos(radians({lat})) * 111320.0::double"
        x1, y1, x2, y2 = f"(({ax}e0 - {lng}) * {e})", f"(({ay}e0 - {lat}) * 110540.0::double)", f"(({bx}e0 - {lng}) * {e})", f"(({by}e0 - {lat}) * 110540.0::double)"
        dx, dy = f"({x2} - {x1})", f"({y2} - {y1})"
        t = f"least(greatest(-({x1} * {dx} + {y1} * {dy}) / ({dx} * {dx} + {dy} * {dy}), 0e0), 1e0)"
        near.append(f"sqrt(pow({x1} + {t} * {dx}, 2) + pow({y1} + {t} * {dy}, 2))")
    return f"least({', '.join(near)})"


def _turn(a: tuple[str, str], b: tuple[str, str], c: tuple[str, str]) -> str:
    return f"(({b[1]} - {a[1]}) * ({c[0]} - {a[0]}) - ({b[0]} - {a[0]}) * ({c[1]} - {a[1]}))"


def crosses(a: tuple[str, str], b: tuple[str, str], c: tuple[str, str], d: tuple[str, str]) -> str:
    """Whether two segments of (lat, lng) share a point."""
    t = [_turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)]
    on = lambda turn, x, y, p: f"(abs({turn}) <= 1e-12 and " + " and ".join(f"{p[i]} between least({x[i]}, {y[i]}) - 1e-12 and greatest({x[i]}, {y[i]}) + 1e-12" for i in (0, 1)) + ")"
    touching = " or ".join([on(t[0], a, b, c), on(t[1], a, b, d), on(t[2], c, d, a), on(t[3], c, d, b)])
    return f"((({t[0]} > 0) <> ({t[1]} > 0) and ({t[2]} > 0) <> ({t[3]} > 0)) or {touching})"


def crosses_ring(a: tuple[str, str], b: tuple[str, str], ring: list = B.RING) -> str:
    point = lambda p: (f"{p[0]}e0", f"{p[1]}e0")
    return "(" + " or ".join(crosses(a, b, point(c), point(d)) for c, d in zip(ring, ring[1:])) + ")"


def along_line(lat: str, lng: str, line: list) -> str:
    """A list of {off, index, along} of a fixed line's segments, and the line's length, on a plane around a point: (spots, length)."""
    e = f"cos(radians({lat})) * 111320.0::double"
    xy = [(f"(({x}e0 - {lng}) * {e})", f"(({y}e0 - {lat}) * 111320.0::double)") for y, x in line]
    walked, spots = "0e0", []
    for i, ((ax, ay), (bx, by)) in enumerate(zip(xy, xy[1:])):
        dx, dy = f"({bx} - {ax})", f"({by} - {ay})"
        length = f"sqrt({dx} * {dx} + {dy} * {dy})"
        t = f"least(greatest(-({ax} * {dx} + {ay} * {dy}) / ({length} * {length}), 0e0), 1e0)"
        spots.append(f"{{'off': sqrt(pow({ax} + {t} * {dx}, 2) + pow({ay} + {t} * {dy}, 2)), 'index': {i}, 'along': {walked} + {length} * {t}}}")
        walked = f"{walked} + {length}"
    return f"list_min([{', '.join(spots)}])", f"({walked})"


def krueger(lat: str, lng: str) -> tuple[str, str]:
    """Easting and northing in zone 32, by the same published series as geo.utm32()."""
    from wayfold.functions import geo

    q = f"{2 * geo._N**0.5 / (1 + geo._N)!r}::double"
    sin = f"sin(radians({lat}))"
    t = f"sinh(atanh({sin}) - {q} * atanh({q} * {sin}))"
    lam = f"radians({lng} - 9e0)"
    xi, eta = f"atan({t} / cos({lam}))", f"atanh(sin({lam}) / sqrt(1 + {t} * {t}))"
    east = eta + "".join(f" + ({a!r}::double) * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(geo._FORWARD, 1))
    north = xi + "".join(f" + ({a!r}::double) * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(geo._FORWARD, 1))
    return f"(500000e0 + {geo.UTM_RADIUS!r}::double * ({east}))", f"({geo.UTM_RADIUS!r}::double * ({north}))"
