"""Contracts on evidence: each rule is a boolean column that must be true. They check what is claimed, and never add precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions import geo

#: Kinds of points, methods that derive one, methods that read one from a source, and what counts as a derived metric.
POINT_TYPES = ("source_point", "representative_point")
DERIVED_METHODS = ("source_centroid", "bounds_midpoint", "geometry_mean", "route_geometry_coordinate")
SOURCE_METHODS = ("source_node", "entrance_node", "field_observation")
DERIVED_KINDS = ("derived", "derived_summary", "source_qualified_derived")
UNKNOWN_HEIGHT = "unknown_no_measurement_source"


def named(x: Column) -> Column:
    """Whether a text says something."""
    return F.coalesce(F.trim(x) != "", F.lit(False))


def valid_accuracy(x: Column) -> Column:
    """Unknown, or a finite number that isn't negative."""
    return x.isNull() | F.coalesce(geo.finite(x) >= 0, F.lit(False))


def _implies(when: Column, then: Column) -> Column:
    return ~F.coalesce(when, F.lit(False)) | F.coalesce(then, F.lit(False))


def position_rules(p: Column) -> dict[str, Column]:
    """Of a struct (provider, element, document_ref, method, position_type, accuracy, status, retrieved_at, retrieval_status)."""
    representative, source = p["position_type"] == "representative_point", p["position_type"] == "source_point"
    return {
        "position_provider": named(p["provider"]),
        "position_reference": named(p["element"]) | named(p["document_ref"]),
        "position_method": named(p["method"]),
        "position_type": p["position_type"].isin(*POINT_TYPES),
        "position_accuracy": valid_accuracy(p["accuracy"]),
        "position_status": named(p["status"]),
        "exact_needs_number": _implies(F.contains(F.lower(p["status"]), F.lit("exact")), p["accuracy"].isNotNull()),
        "representative_not_from_source": _implies(representative, ~F.coalesce(p["method"].isin(*SOURCE_METHODS), F.lit(False))),
        "representative_discloses": _implies(representative, ~F.coalesce(p["status"] == "not_reported_by_source", F.lit(False))),
        "source_not_derived": _implies(source, ~F.coalesce(p["method"].isin(*DERIVED_METHODS), F.lit(False))),
        "entrance_is_source": _implies(p["method"] == "entrance_node", source),
        "retrieved_at_text": p["retrieved_at"].isNull() | named(p["retrieved_at"]),
        "retrieval_status": _implies(p["retrieved_at"].isNull(), named(p["retrieval_status"])),
    }


def elevation_rules(e: Column) -> dict[str, Column]:
    """Of a struct (provider, dataset, resolution, accuracy, status, snapshot, retrieved_at)."""
    return {
        "elevation_provider": named(e["provider"]),
        "elevation_dataset": named(e["dataset"]),
        "elevation_resolution": geo.finite(e["resolution"]) > 0,
        "elevation_accuracy": valid_accuracy(e["accuracy"]),
        "elevation_status": named(e["status"]),
        "elevation_snapshot": named(e["snapshot"]),
        "elevation_retrieved_at": e["retrieved_at"].isNull() | named(e["retrieved_at"]),
    }


def height_rules(height: Column, status: Column, source: Column, elevation: Column) -> dict[str, Column]:
    """Of a physical height with its source, a struct (measurement_kind, reference), and the terrain's, a struct (reference, ...): a height is never read off terrain."""
    known = height.isNotNull()
    return {
        "unknown_height_stays_unknown": known | (F.coalesce(status == UNKNOWN_HEIGHT, F.lit(False)) & source.isNull()),
        "height_not_negative": _implies(known, geo.finite(height) >= 0),
        "height_has_source": _implies(known, source.isNotNull()),
        "height_is_physical": _implies(known & source.isNotNull(), source["measurement_kind"] == "physical_height"),
        "height_not_from_terrain": _implies(known & source.isNotNull(), ~F.coalesce(source["reference"] == elevation["snapshot"], F.lit(False))),
        "height_status": _implies(known, named(status) & (status != UNKNOWN_HEIGHT)),
    }


def coordinate_rules(lat: Column, lng: Column, elevation: Column) -> dict[str, Column]:
    return {f"{n}_finite": geo.finite(x).isNotNull() for n, x in (("lat", lat), ("lng", lng), ("elevation", elevation))}


def metric_rules(m: Column) -> dict[str, Column]:
    """Of a metric's definition, a struct (kind, algorithm, source_fields, assumptions), null where there is none."""
    fields = m["source_fields"]
    return {
        "definition": m.isNotNull(),
        "kind": m["kind"].isin(*DERIVED_KINDS),
        "algorithm": named(m["algorithm"]),
        "source_fields": (F.size(fields) > 0) & F.forall(fields, named),
        "assumptions": named(m["assumptions"]),
    }
