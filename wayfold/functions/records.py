"""Records from raw elements: points, provenance, families, labels and short texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions import geo

#: How a point was derived, what it then is, and what is known of its accuracy.
METHODS = {
    "osm_node": ("source_node", "source_point", "not_reported_by_source"),
    "osm_center": ("source_centroid", "representative_point", "derived_representative_point"),
    "osm_bounds_midpoint": ("bounds_midpoint", "representative_point", "derived_representative_point"),
    "osm_geometry_mean": ("geometry_mean", "representative_point", "derived_representative_point"),
}
#: Families of visitor features in their order.
FAMILIES = ("access", "toilet", "drinking_water", "viewpoint", "shelter", "transit", "artwork")
#: Metres from the boundary within which an entrance, a barrier or a toilet outside still counts.
NEAR_ENTRANCE_M, NEAR_BARRIER_M, NEAR_TOILET_M = 100.0, 25.0, 100.0
#: Patterns that name a tree's part of the park, the first that matches.
SECTORS = [
    ("(?iu)löwenburg|loewenburg|burgweg|burgwiese", "loewenburg"),
    ("(?iu)herkules|kaskad|fontän|fontaen|neptun|aquädukt|aquaedukt|wasserfall", "water-axis"),
    ("(?iu)schloss wilhelmshöhe|schloss wilhelmshoehe|bowlinggreen|\\blac\\b", "palace-lac"),
    ("(?iu)apolloberg|gewächshaus|gewaechshaus", "apolloberg"),
    ("(?iu)mulang|chines", "mulang"),
    ("(?iu)tulpenallee|gärtnerei|gaertnerei|waldschule|nordost|nordöst", "north-east"),
    ("(?iu)roseninsel", "roseninsel"),
]
#: Relations in English.
RELATIONS = {"created": "created", "co_created": "co-created", "designed": "designed", "co_designed": "co-designed", "lead_designer_of": "led the design of", "commissioned": "commissioned", "initiated": "initiated", "member_of_collection": "belongs to the collection", "displayed_at": "is displayed at", "installed_at": "is installed at", "located_at": "is located at"}


def midpoint(low: Column, high: Column) -> Column:
    return (low + high) / 2


def representative_point(point: Column, center: Column, box: Column, geometry: Column) -> Column:
    """(lat, lng, method): an element's own point, else its centre, else the middle of its bounds, else its vertices' mean; null if it has none.

    ``point`` and ``center`` are structs (lat, lng), ``box`` (south, west, north, east), ``geometry`` an array of (lat, lng).
    """
    mean = lambda c: F.aggregate(geometry, F.lit(0.0), lambda acc, p: acc + p[c]) / F.size(geometry)
    out = lambda lat, lng, method: F.struct(lat.alias("lat"), lng.alias("lng"), F.lit(method).alias("method"))
    return (
        F.when(point.isNotNull(), out(point["lat"], point["lng"], "osm_node"))
        .when(center.isNotNull(), out(center["lat"], center["lng"], "osm_center"))
        .when(box.isNotNull(), out(midpoint(box["south"], box["north"]), midpoint(box["west"], box["east"]), "osm_bounds_midpoint"))
        .when(F.size(geometry) > 0, out(mean("lat"), mean("lng"), "osm_geometry_mean"))
    )


def position_source(method: Column) -> Column:
    """(method, position_type, accuracy_status) that a derivation method stands for; a method that isn't known fails."""
    out = None
    for name, values in METHODS.items():
        row = F.struct(*(F.lit(v).alias(k) for k, v in zip(("method", "position_type", "accuracy_status"), values)))
        out = F.when(method == name, row) if out is None else out.when(method == name, row)
    fail = F.raise_error(F.concat(F.lit("unsupported coordinate method "), method)).cast("struct<method:string,position_type:string,accuracy_status:string>")
    return out.when(method.isNotNull(), fail)


def family(tags: dict[str, Column], inside: Column, boundary_m: Column, outside_viewpoint: Column, transit_name: Column) -> Column:
    """The family of a visitor feature by its tags and its place, null for none; the first that applies, access points apart.

    ``tags`` has amenity, drinking_water, tourism and public_transport.
    """
    is_ = lambda key, value: F.coalesce(tags[key] == value, F.lit(False))
    return (
        F.when(is_("amenity", "toilets") & (inside | (boundary_m <= NEAR_TOILET_M)), "toilet")
        .when((is_("amenity", "drinking_water") | is_("drinking_water", "yes")) & inside, "drinking_water")
        .when(is_("tourism", "viewpoint") & (inside | outside_viewpoint), "viewpoint")
        .when(is_("amenity", "shelter") & inside, "shelter")
        .when(is_("tourism", "artwork") & inside, "artwork")
        .when(is_("public_transport", "platform") & transit_name, "transit")
    )


def is_access_point(entrance: Column, barrier: Column, inside: Column, boundary_m: Column) -> Column:
    """Whether a node counts as a way in: an entrance or barrier inside, or near enough to the boundary."""
    near = (entrance.isNotNull() & (boundary_m <= NEAR_ENTRANCE_M)) | (barrier.isNotNull() & (boundary_m <= NEAR_BARRIER_M))
    return (entrance.isNotNull() | barrier.isNotNull()) & (inside | near)


def scope(inside: Column, boundary_m: Column, relevant: Column) -> Column:
    """(relation, boundary_distance_m): how a feature lies to the park."""
    relation = F.when(inside, "inside_park").when(relevant, "external_relevant").otherwise("boundary_external")
    return F.struct(relation.alias("relation"), F.round(boundary_m, 1).alias("boundary_distance_m"))


def sector(explicit: Column, location: Column) -> Column:
    """A tree's part of the park: as stated, else by the first pattern that its location matches, else other-park."""
    out = F.when(F.trim(F.coalesce(explicit, F.lit(""))) != "", F.trim(explicit))
    for pattern, name in SECTORS:
        out = out.when(location.rlike(pattern), name)
    return out.otherwise("other-park")


def dataset_state(n: Column, status: Column) -> Column:
    """pending without rows, ready if the status says so, else partial."""
    said = F.lower(F.coalesce(status, F.lit("")))
    return F.when(n == 0, "pending").when(F.contains(said, F.lit("complete")) | F.contains(said, F.lit("ready")), "ready").otherwise("partial")


def relation_label(relation: Column) -> Column:
    """A relation in words: its own, else its name without underscores, else 'Relation'."""
    known = F.create_map(*(F.lit(x) for pair in RELATIONS.items() for x in pair))
    plain = F.trim(F.replace(F.coalesce(relation, F.lit("")), F.lit("_"), F.lit(" ")))
    return F.coalesce(F.try_element_at(known, relation), F.nullif(plain, F.lit("")), F.lit("Relation"))


def feature_label(name: Column, family_label: Column, ident: Column) -> Column:
    """A feature's own name, else its family with its source's id, else the family alone."""
    return F.coalesce(F.nullif(name, F.lit("")), F.concat_ws(" · ", family_label, F.nullif(ident, F.lit(""))))


#: What families are called in English.
FAMILY_LABELS = {"bench": "Benches", "access": "Access & barriers", "toilet": "Toilets", "drinking_water": "Drinking water", "viewpoint": "Viewpoints", "shelter": "Shelters", "transit": "Transit access", "artwork": "Artworks"}


def family_label(kind: Column) -> Column:
    """A family in words: its own, else its name without underscores."""
    known = F.create_map(*(F.lit(x) for pair in FAMILY_LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, kind), F.replace(F.coalesce(kind, F.lit("visitor_poi")), F.lit("_"), F.lit(" ")))


def middle_vertex(coordinates: Column) -> Column:
    """The vertex in the middle of an array of coordinates, the lower one of two, null without any."""
    return F.get(coordinates, F.floor((F.size(coordinates) - 1) / 2).cast("int"))


def first_text(*columns: Column) -> Column:
    """The first of several texts that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def has_heritage(historic: Column) -> Column:
    return F.coalesce((historic != "") & (historic != "no"), F.lit(False))


def whole(x: Column) -> Column:
    """A number as text without decimals, halves rounded up."""
    return F.floor(x + 0.5).cast("long").cast("string")


def tenths(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%.1f", F.round(x, 1)))


def terrain_summary(direction: Column, ascent: Column, descent: Column, low: Column, high: Column, grade: Column, status: Column) -> Column:
    """A route's terrain in one line; what isn't known is left out, and the elevation's source closes it."""
    words = F.when(direction == "level", "nearly level").when(direction == "unknown", "direction unknown").otherwise(direction)
    source = F.when(status == "dgm1", "DGM1").when(status == "legacy", "GLO-90 fallback").otherwise("elevation unknown")
    signed = F.concat(F.when(grade > 0, "+").otherwise(""), tenths(grade), F.lit("%"))
    return F.concat_ws(" · ", words, F.concat(F.lit("↑ "), whole(ascent), F.lit(" m")), F.concat(F.lit("↓ "), whole(descent), F.lit(" m")), F.concat(whole(low), F.lit("–"), whole(high), F.lit(" m")), F.concat(F.lit("net "), signed), source)


def access_summary(has_steps: Column, access: Column) -> Column:
    return F.when(has_steps, "Mapped steps").when(access == "potentially_step_free_mapped_path", "Mapped path may be step-free").when(access == "limited", "Mapped limited accessibility").otherwise("Accessibility not fully evidenced")


def route_note(step_m: Column) -> Column:
    """What a walker is told of steps: their length, or that nothing was verified on the spot."""
    steps = F.concat(F.lit("OSM route contains about "), F.format_string("%.0f", F.bround(step_m)), F.lit(" m of steps; not step-free."))
    return F.when(step_m > 0, steps).otherwise("OSM walking route with segment-level surfaces and GLO-90 elevation profile; accessibility not field-verified.")


def tag_evidence(segments: Column, key: str) -> Column:
    """(n, values) of a tag in an array of segments: how many have it, and its different values, the first seen first."""
    held = F.transform(F.filter(segments, lambda s: s[key].isNotNull()), lambda s: s[key])
    return F.struct(F.size(held).alias("n"), F.array_join(F.array_distinct(held), ", ").alias("values"))


def evidence_text(n: Column, values: Column, what: str) -> Column:
    return F.when(n == 0, f"No explicit {what} tags on the mapped segments.").otherwise(F.concat(F.lit(f"OSM {what} evidence on "), n.cast("string"), F.lit(" segment(s): "), values, F.lit(".")))


def presentation(scale: Column, kind: Column, default_kind: str, kinds: tuple[str, ...]) -> Column:
    """(kind, scale): a display kind among those there are, else the default, and a scale between 0.7 and 1.6, 1 where none is given."""
    size = geo.clamp(F.coalesce(geo.finite(scale), F.lit(1.0)), 0.7, 1.6)
    return F.struct(F.when(kind.isin(*kinds), kind).otherwise(default_kind).alias("kind"), size.alias("scale"))
