"""Map features as GeoJSON text, accuracy circles, profile lines, links, and text for people and speech. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The earth's radius in metres, the vertices of a circle less one, its largest radius, a profile's width, height and margin.
EARTH_M, CIRCLE_STEPS, MOST_ACCURACY_M, WIDTH, HEIGHT, MARGIN = 6_371_008.8, 32, 150.0, 240, 56, 5
#: What a link may name, and the sections of a narration, in order.
LINK_KINDS = ("place", "tree", "feature")
SECTIONS = ("description", "history", "architecture", "significance", "visitorContext")


def _finite(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def _feature(properties: Column, kind: str, coordinates: Column) -> Column:
    """A feature as JSON text; null without coordinates."""
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.when(coordinates.isNotNull(), F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))))


def point_feature(properties: Column, lng: Column, lat: Column) -> Column:
    """A point; null where a coordinate isn't finite."""
    both = _finite(lng).isNotNull() & _finite(lat).isNotNull()
    return _feature(properties, "Point", F.when(both, F.array(_finite(lng), _finite(lat))))


def line_feature(properties: Column, points: Column) -> Column:
    """A line of (lng, lat) structs without those that aren't finite; null with fewer than two left."""
    kept = F.filter(F.transform(points, lambda p: F.array(_finite(p["lng"]), _finite(p["lat"]))), lambda p: p[0].isNotNull() & p[1].isNotNull())
    return _feature(properties, "LineString", F.when(F.size(kept) >= 2, kept))


def accuracy_ring(lat: Column, lng: Column, accuracy: Column) -> Column:
    """A circle's vertices [lng, lat], the first again at the end: as many metres around a fix as its accuracy says, at most MOST_ACCURACY_M.

    Null without a place, and without an accuracy above 0.
    """
    radius = F.least(F.greatest(F.coalesce(_finite(accuracy), F.lit(0.0)), F.lit(0.0)), F.lit(MOST_ACCURACY_M))
    lat, lng = _finite(lat), _finite(lng)
    angle = lambda i: i.cast("double") / CIRCLE_STEPS * 2 * F.pi()
    north = lambda i: F.degrees(F.sin(angle(i)) * radius / EARTH_M)
    east = lambda i: F.degrees(F.cos(angle(i)) * radius / (F.lit(EARTH_M) * F.cos(F.radians(lat))))
    ring = F.transform(F.sequence(F.lit(0), F.lit(CIRCLE_STEPS)), lambda i: F.array(lng + east(i), lat + north(i)))
    return F.when(lat.isNotNull() & lng.isNotNull() & (radius > 0), ring)


def polygon_feature(properties: Column, ring: Column) -> Column:
    return _feature(properties, "Polygon", F.when(ring.isNotNull(), F.array(ring)))


def profile_points(distances: Column, elevations: Column, width: int = WIDTH, height: int = HEIGHT) -> Column:
    """``x,y`` pairs with one decimal of a profile scaled to a box: distances from left to right, the highest point MARGIN from the top.

    Empty unless both arrays are as long as one another, not empty and finite. Flat and very short profiles are scaled as if 1 m high and long.
    Rounded are ten times the value, as SQL does it: of 26.849999999999998 that makes 26.9, and its digits alone 26.8.
    """
    fine = (F.size(elevations) > 0) & (F.size(distances) == F.size(elevations)) & F.forall(elevations, lambda z: _finite(z).isNotNull()) & F.forall(distances, lambda d: _finite(d).isNotNull())
    low = F.array_min(elevations)
    span = F.greatest(F.lit(1.0), F.array_max(elevations) - low)
    start = F.get(distances, F.lit(0))
    across = F.greatest(F.lit(1.0), F.element_at(distances, -1) - start)
    one = lambda x: F.format_string("%.1f", F.round(x * 10) / 10)
    pairs = F.zip_with(distances, elevations, lambda d, z: F.concat(one((d - start) / across * width), F.lit(","), one(F.lit(height - MARGIN) - (z - low) / span * (height - 2 * MARGIN))))
    return F.when(F.coalesce(fine, F.lit(False)), F.array_join(pairs, " ")).otherwise("")


def percent_encoded(text: Column) -> Column:
    """Text for a link: all but letters, digits and ``-_.!~*'()`` of ASCII as the bytes of its UTF-8."""
    bytes_of = F.regexp_replace(F.hex(F.encode(text, "utf-8")), "(..)", "%$1")
    plain = [c for c in map(chr, range(128)) if c.isalnum() or c in "-_.!~*'()"]
    for c in plain:
        bytes_of = F.replace(bytes_of, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return bytes_of


def deep_link(kind: Column, id: Column) -> Column:
    """``#kind=id``; null for another kind, and without an id."""
    return F.when(kind.isin(*LINK_KINDS) & (F.length(id) > 0), F.concat(F.lit("#"), kind, F.lit("="), percent_encoded(id)))


def parsed_link(link: Column) -> Column:
    """(kind, id) of a link; null where it isn't one, or its id isn't encoded as it should be."""
    pattern = "^#(place|tree|feature)=([^&]+)"
    coded = F.regexp_extract(link, pattern, 2)
    well = ~F.regexp_replace(coded, "%[0-9A-Fa-f]{2}", "").contains("%") & (F.length(coded) > 0)
    # a plus sign is itself here, unlike in a form
    id = F.try_url_decode(F.when(well, F.replace(coded, F.lit("+"), F.lit("%2B"))))
    return F.when(well & id.isNotNull(), F.struct(F.regexp_extract(link, pattern, 1).alias("kind"), id.alias("id")))


def escaped_html(text: Column) -> Column:
    """Text with the five characters that markup takes for itself written as entities; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(c), F.lit(entity))
    return out


def speech_tag(language: Column) -> Column:
    """The tag of the voice for a language: British English for English, German for any other."""
    return F.when(language == "en", "en-GB").otherwise("de-DE")


def narration(title: Column, sections: dict[str, Column]) -> Column:
    """What is read out: title and sections in order, empty ones left out, joined as sentences. A title alone is no narration: null."""
    text = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    said = [text(sections[s]) for s in SECTIONS if s in sections] or [F.lit(None).cast("string")]
    return F.when(F.coalesce(*said).isNotNull(), F.concat_ws(". ", text(title), *said))
