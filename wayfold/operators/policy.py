"""What of an entity is shown, by distance and attention, and when that changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.functions import geo

#: How large each mode and each highlight is drawn.
MODE_SCALE = {"full": 1.0, "cue": 0.72, "hidden": 1.0}
HIGHLIGHT_SCALE = {"none": 1.0, "selected": 1.08, "focused": 1.14, "selected-focused": 1.2}


def bounded(x: Column) -> Column:
    """A finite number, negative ones as 0; null for anything else."""
    x = x.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.greatest(x, F.lit(0.0)))


def bands(full: Column, cue: Column, hide: Column) -> tuple[Column, Column, Column]:
    """Distances up to which an entity is shown in full, as a cue, and at all: made finite and ascending. What is missing takes the band before it."""
    a = F.coalesce(bounded(full), F.lit(0.0))
    b = F.greatest(a, F.coalesce(bounded(cue), a))
    return a, b, F.greatest(b, F.coalesce(bounded(hide), b))


def highlight(entity: Column, selected: Column, focused: Column) -> Column:
    """none, selected, focused or both; an empty or missing id names no entity."""
    named = lambda c: F.coalesce((c == entity) & (F.length(c) > 0), F.lit(False))
    return F.when(named(selected) & named(focused), "selected-focused").when(named(focused), "focused").when(named(selected), "selected").otherwise("none")


def decide(views: DataFrame) -> DataFrame:
    """``views`` with mode, reason, highlight and scale.

    A view has entity, distance_m, in_view, full_m, cue_m, hide_m, selected, focused, reduced_motion and low_power. An entity out of view is hidden; one at an unknown distance is
    shown in full. Between the cue band and the hard cap only a highlighted one keeps its cue; beyond the cap none does. Reduced motion
    and low power turn full into a cue.
    """
    full, cue, hide = bands(F.col("full_m"), F.col("cue_m"), F.col("hide_m"))
    # one column each, or the plan repeats their expressions in every branch
    at = views.withColumns({"_full": full, "_cue": cue, "_hide": hide, "_far": bounded(F.col("distance_m")), "highlight": highlight(F.col("entity"), F.col("selected"), F.col("focused"))})
    far, lit_up = F.col("_far"), F.col("highlight") != "none"
    reason = F.when(~F.coalesce("in_view", F.lit(True)), "outside-view").when(far.isNull(), "distance-unavailable-preserve-full").when(far <= F.col("_full"), "within-full").when(far <= F.col("_cue"), "within-cue")
    reason = reason.when((far <= F.col("_hide")) & lit_up, "interaction-retained-cue").when(far > F.col("_hide"), "beyond-hard-cap").otherwise("culled-fringe")
    at = at.withColumn("reason", reason)
    in_full = F.col("reason").isin("within-full", "distance-unavailable-preserve-full")
    lowered = F.when(in_full & F.coalesce("low_power", F.lit(False)), "power-downgrade").when(in_full & F.coalesce("reduced_motion", F.lit(False)), "reduced-motion-downgrade")
    at = at.withColumn("reason", F.coalesce(lowered, F.col("reason")))
    mode = F.when(F.col("reason").isin("within-full", "distance-unavailable-preserve-full"), "full").when(F.col("reason").isin("outside-view", "beyond-hard-cap", "culled-fringe"), "hidden").otherwise("cue")
    scale = lambda c, table: F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col(c))
    at = at.withColumn("mode", mode)
    return at.withColumn("scale", scale("mode", MODE_SCALE) * scale("highlight", HIGHLIGHT_SCALE)).drop("_full", "_cue", "_hide", "_far")


def signature() -> Column:
    """What a decision looks like from outside: hidden ones are all alike, others differ by mode, highlight and scale."""
    return F.when(F.col("mode") == "hidden", "hidden").otherwise(F.concat_ws(":", "mode", "highlight", F.format_number("scale", 4)))


def changes(views: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Of decide()'s rows those that look different from the one before of the same ``by``, with signature and the one before (null at first)."""
    told = decide(views).withColumn("signature", signature())
    told = told.withColumn("before", F.lag("signature").over(W.partitionBy(*by).orderBy(*order)))
    return told.filter(~F.col("signature").eqNullSafe(F.col("before")))


def host_views(entities: DataFrame) -> DataFrame:
    """``entities`` (lat, lng) with distance_m from a camera (center_lat, center_lng) and in_view within bounds (west, south, east, north).

    What isn't known hides nothing: without a camera or a place the distance is null, without bounds or a place the entity is in view. Bounds may cross the antimeridian; a
    span of 360 degrees or more holds every longitude.
    """
    place = geo.finite(F.col("lat")).isNotNull() & geo.finite(F.col("lng")).isNotNull()
    sides = [geo.finite(F.col(c)) for c in ("west", "south", "east", "north")]
    west, south, east, north = sides
    bounds = west.isNotNull() & south.isNotNull() & east.isNotNull() & north.isNotNull() & (south <= north)
    inside = F.col("lat").between(south, north) & ((F.abs(east - west) >= 360) | F.coalesce(geo.longitude_between(F.col("lng"), west, east), F.lit(True)))
    center = geo.finite(F.col("center_lat")).isNotNull() & geo.finite(F.col("center_lng")).isNotNull()
    distance = F.when(place & center, geo.surface_distance(F.col("center_lat"), F.col("center_lng"), F.col("lat"), F.col("lng")))
    return entities.withColumn("distance_m", distance).withColumn("in_view", F.when(place & F.coalesce(bounds, F.lit(False)), inside).otherwise(True))


def renderer(preference: Column, reduced_power: Column, webgl2: Column, terrain: Column) -> Column:
    """(renderer, fallback): terrain only where it is asked for and the device can draw it, else the plain map and why."""
    no = F.lit(False)
    why = F.when(F.coalesce(reduced_power, no), "reduced-power").when(~F.coalesce(webgl2, no), "webgl2-unavailable").when(~F.coalesce(terrain, no), "terrain-renderer-unavailable")
    fallback = F.when(F.coalesce(preference == "terrain", no), why)
    return F.struct(F.when(F.coalesce(preference == "terrain", no) & fallback.isNull(), "terrain").otherwise("leaflet").alias("renderer"), fallback.alias("fallback"))
