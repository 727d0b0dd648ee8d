"""Tag normalisation and classification ladders. Unknown stays unknown: null is neither false nor zero."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ways that can be walked, and foot values that lift an access ban.
WALKABLE = ("footway", "path", "steps", "pedestrian", "track", "service", "living_street", "residential", "unclassified", "tertiary")
FOOT_EXCEPTIONS = ("yes", "designated", "permissive")
#: Surface buckets.
SURFACES = {
    "paved": ("asphalt", "paved", "paving_stones", "sett", "cobblestone", "concrete", "concrete:plates"),
    "gravel": ("gravel", "fine_gravel", "compacted", "pebblestone"),
    "dirt": ("dirt", "earth", "ground", "mud", "unpaved"),
    "grass": ("grass",),
}


def pedestrian_policy(highway: Column, foot: Column, access: Column) -> Column:
    """The first reason to leave a way out, or 'included'."""
    banned = access.isin("private", "no") & ~F.coalesce(foot.isin(*FOOT_EXCEPTIONS), F.lit(False))
    return F.when(~F.coalesce(highway.isin(*WALKABLE), F.lit(False)), "not_walkable").when(F.coalesce(foot == "no", F.lit(False)), "foot_no").when(F.coalesce(banned, F.lit(False)), "access_restricted").otherwise("included")


def surface_bucket(raw: Column, highway: Column) -> Column:
    out = F.when(highway == "steps", "stone_steps")
    for bucket, values in SURFACES.items():
        out = out.when(raw.isin(*values), bucket)
    return out.otherwise("unknown")


def access_banned(access: Column, foot: Column) -> Column:
    """Whether access is private or denied and nothing lets pedestrians through all the same."""
    return F.coalesce(access.isin("private", "no"), F.lit(False)) & ~F.coalesce(foot.isin(*FOOT_EXCEPTIONS), F.lit(False))


def node_block(foot: Column, access: Column) -> Column:
    """Why pedestrians can't pass a node, or null."""
    return F.when(foot == "no", "node_foot_no").when(access_banned(access, foot), "node_access_private_or_no_without_pedestrian_exception")


def segment_allowed(eligible: Column, foot: Column, access: Column, barriers: Column) -> Column:
    """Whether a segment may be walked by its own tags and those of every barrier along it, an array of (foot, access, ...)."""
    closed = lambda f, a: F.coalesce(f == "no", F.lit(False)) | access_banned(a, f)
    at_barrier = F.exists(F.coalesce(barriers, F.filter(barriers, lambda x: F.lit(False))), lambda x: closed(x["foot"], x["access"]))
    return F.coalesce(eligible, F.lit(False)) & ~closed(foot, access) & ~F.coalesce(at_barrier, F.lit(False))


def network_segment_allowed(eligible: Column, distance: Column, steps: Column, *, without_steps: bool) -> Column:
    """The same for a published network: not ruled out, of a known length, and, if wanted, not known to be steps."""
    ok = F.coalesce(eligible, F.lit(True)) & F.coalesce(~F.isnan(distance) & (distance >= 0) & (distance < float("inf")), F.lit(False))
    return ok & ~F.coalesce(steps, F.lit(False)) if without_steps else ok


def pedestrian_oneway(oneway_foot: Column, foot_oneway: Column, highway: Column, conveying: Column) -> Column:
    """forward, reverse or both, by the tags that speak of pedestrians; a vehicle's one-way street is none."""
    value = F.lower(F.trim(F.coalesce(oneway_foot, foot_oneway)))
    tagged = F.when(value.isin("yes", "1", "true"), "forward").when(value.isin("-1", "reverse"), "reverse").otherwise("both")
    moving = F.when((highway == "steps") & (conveying == "forward"), "forward").when((highway == "steps") & (conveying == "backward"), "reverse").otherwise("both")
    return F.when(value.isNotNull(), tagged).otherwise(moving)


def direction_allowed(oneway: Column, direction: Column) -> Column:
    return (oneway == "both") | (oneway == direction)


def traversal_direction(refs: Column, a: Column, b: Column) -> Column:
    """How a list of node ids passes from a to b: forward, reverse, or unknown if they are no neighbours; the first pair found decides."""
    pairs = F.zip_with(F.slice(refs, 1, F.greatest(F.size(refs) - 1, F.lit(0))), F.slice(refs, 2, F.greatest(F.size(refs) - 1, F.lit(0))), lambda x, y: F.when((x == a) & (y == b), "forward").when((x == b) & (y == a), "reverse"))
    return F.coalesce(F.get(F.array_compact(pairs), F.lit(0)), F.lit("unknown"))


def reverse_segments(segments: Column) -> Column:
    """An array of (direction, incline, ...) walked the other way: order and directions turn, and the route's incline follows."""

    def turned(s: Column) -> Column:
        direction = F.when(s["direction"] == "forward", "reverse").when(s["direction"] == "reverse", "forward").otherwise(s["direction"])
        return s.withField("direction", direction).withField("route_incline", reverse_incline(s["incline"], direction))

    return F.transform(F.reverse(segments), turned)


def number_or_null(x: Column) -> Column:
    """A number, with comma or point, else null."""
    return F.replace(F.trim(x), F.lit(","), F.lit(".")).try_cast("double")


def short_number(x: Column) -> Column:
    """A number in six significant digits, without trailing zeros."""
    text = F.format_string("%.6g", x)
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+(e[+-][0-9]+)?$", "$1")).otherwise(text)


def reverse_incline(raw: Column, direction: Column) -> Column:
    """An incline as seen when walking; against a way's direction up and down swap and numbers, with or without %, change sign.

    Null without a direction, without a value, and against the direction for what is neither.
    """
    number = F.trim(F.regexp_replace(raw, "%$", "")).try_cast("double")
    turned = F.when(F.lower(raw) == "up", "down").when(F.lower(raw) == "down", "up").when(number.isNotNull(), F.concat(short_number(-number), F.when(F.endswith(raw, F.lit("%")), "%").otherwise("")))
    return F.when((raw == "") | raw.isNull(), None).when(direction == "reverse", turned).when(direction == "forward", raw)


def segment_access(connector: Column, steps: Column, wheelchair: Column, barriers: Column) -> Column:
    """Negative evidence or unknown; nothing is ever called accessible. ``barriers`` is an array of the barriers along the segment."""
    blocked = F.exists(barriers, lambda x: x.isin("stile", "turnstile"))
    return F.when(connector, "unknown_unmapped_connector").when(steps, "known_steps").when(wheelchair == "no", "known_wheelchair_no").when(blocked, "known_barrier_mobility_constraint").otherwise("unknown_not_field_verified")


def route_access(steps: Column, wheelchair: Column, surface: Column, smoothness: Column, sac_scale: Column) -> Column:
    """The accessibility of a group of segments, an aggregate: what rules a claim out first, a claim only if every surface is known to be firm."""
    yes = lambda x: F.coalesce(F.bool_or(x), F.lit(False))
    rough = surface.isin("dirt", "grass") | smoothness.isin("bad", "very_bad", "horrible", "very_horrible", "impassable") | (F.coalesce(sac_scale, F.lit("")) != "")
    firm = F.bool_and(F.coalesce(surface.isin("paved", "gravel"), F.lit(False)))
    return F.when(yes(steps), "not_step_free").when(yes(wheelchair == "no"), "not_wheelchair_accessible").when(yes(F.coalesce(surface.isin("dirt", "grass"), F.lit(False)) | F.coalesce(rough, F.lit(False))), "limited").when(firm, "potentially_step_free_mapped_path").otherwise("unknown")


#: Fixed value: the elevation model's resolution; over a shorter distance it says nothing of a slope.
DEM_RESOLUTION_M = 90.0


def terrain_metrics(from_m: Column, to_m: Column, distance_m: Column) -> Column:
    """(delta, ascent, descent, grade, status) between two elevations; ascent, descent and grade are null below the model's resolution."""
    delta, sure = to_m - from_m, distance_m >= DEM_RESOLUTION_M
    return F.struct(
        F.round(delta, 1).alias("delta"),
        F.when(sure, F.round(F.greatest(delta, F.lit(0.0)), 1)).alias("ascent"),
        F.when(sure, F.round(F.greatest(-delta, F.lit(0.0)), 1)).alias("descent"),
        F.when(sure, F.round(delta / distance_m * 100, 1)).alias("grade"),
        F.when(sure, "coarse_glo90_endpoint_estimate").otherwise("below_dem_horizontal_resolution").alias("status"),
    )


def terrain_direction(delta_m: Column, deadband: float = 2.0) -> Column:
    """uphill, downhill or level, and unknown for an unknown difference."""
    return F.when(delta_m.isNull() | F.isnan(delta_m), "unknown").when(delta_m > deadband, "uphill").when(delta_m < -deadband, "downhill").otherwise("level")


def stable_id(prefix: str, *parts: Column, length: int = 12) -> Column:
    """A name that the parts decide: the first digits of their SHA-1, with slashes between them."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha1(F.concat_ws("/", *parts)), 1, length))


def node_name(place: Column, osm: Column, lat: Column, lng: Column) -> Column:
    """A path node's id: by its place, else by its map node, else by its coordinates."""
    by_place = F.concat(F.lit("pathnode-place-"), place)
    by_map = F.concat(F.lit("pathnode-osm-"), osm.cast("string"))
    return F.coalesce(by_place, by_map, F.concat(F.lit("pathnode-coordinate-"), F.substring(F.sha1(F.format_string("%.7f,%.7f", lat, lng)), 1, 12)))


def localized(de: Column, en: Column, language: str, other: Column) -> Column:
    """A text in a language, else in the other one (German first), else ``other``; empty texts don't count."""
    de, en = F.nullif(de, F.lit("")), F.nullif(en, F.lit(""))
    return F.coalesce(*((en, de) if language == "en" else (de, en)), other)


def one_or_mixed(x: Column) -> Column:
    """The only value of a group as text, 'mixed' for several, null for none; null and empty don't count. An aggregate."""
    value = F.nullif(x.cast("string"), F.lit(""))
    return F.when(F.count_distinct(value) > 1, "mixed").otherwise(F.min(value))


def first_absolute_url(values: Column) -> Column:
    """The first http or https address of an array, else null."""
    return F.get(F.filter(values, lambda x: F.rlike(F.trim(x), F.lit("(?i)^https?://[^ /]+"))), F.lit(0))


def first_match(x: Column, patterns: list[tuple[str, str]], other: str) -> Column:
    """The label of the first pattern that x matches."""
    return reduce(lambda out, p: out.when(x.rlike(p[0]), p[1]), patterns[1:], F.when(x.rlike(patterns[0][0]), patterns[0][1])).otherwise(other)


@cache
def _plain_letters() -> tuple[str, str, dict[str, str]]:
    """Letters to take apart and what they come to, position by position, then the marks to drop; and those that come to several letters.

    By the rule of compatibility decomposition without combining marks, for all letters and marks that exist.
    """
    one, several, marks = {}, {}, []
    for code in range(0xA0, sys.maxunicode + 1):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Mn":
            marks.append(c)
        elif kind[0] == "L" and not 0xAC00 <= code <= 0xD7A3:
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x) != "Mn")
            if plain != c:
                (one if len(plain) == 1 else several)[c] = plain
    latin = {c: x for c, x in several.items() if unicodedata.name(c, "").startswith("LATIN")}
    return "".join(one) + "".join(marks), "".join(one.values()), latin


def fold_text(x: Column) -> Column:
    """Lower case, trimmed, without accents: letters are taken apart and their marks dropped. Latin ligatures come apart too."""
    letters, plain, ligatures = _plain_letters()
    out = F.translate(x, letters, plain)
    for c, letters_of in ligatures.items():
        out = F.replace(out, F.lit(c), F.lit(letters_of))
    return F.trim(F.lower(out))


def match_tier(field: Column, needle: Column) -> Column:
    """0 exact, 1 prefix, 2 contained, else null; an empty field never matches."""
    return F.when(field == "", None).when(field == needle, 0).when(F.startswith(field, needle), 1).when(F.contains(field, needle), 2)
