"""The whole report: every check over graph, layers and provenance in one table, put together from the audits of the other modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import contracts
from wayfold.plans import contract_queries, discovery_queries, network_queries, record_queries, source_queries  # noqa: F401
from wayfold.plans.registry import oracle_sql, queries, query

#: Name of a check: the audit whose rows are its failures, which of them, and the key to name them by.
_AUDITS = {
    "place_position_provenance_normalized": ("place_positions", "true", "id"),
    "representative_positions_qualified": ("entity_contract", "rule in ('representative_not_from_source', 'representative_discloses')", "id"),
    "source_positions_not_derived": ("entity_contract", "rule in ('source_not_derived', 'entrance_is_source')", "id"),
    "exactness_has_a_number": ("entity_contract", "rule = 'exact_needs_number'", "id"),
    "elevation_provenance": ("entity_contract", "rule like 'elevation%'", "id"),
    "heights_not_from_terrain": ("entity_contract", "rule like 'height%' or rule = 'unknown_height_stays_unknown'", "id"),
    "derived_metric_provenance": ("metric_contract", "true", "profile"),
    "geotag_crosscheck": ("tolerance_audit", "true", "id"),
    "detours_to_review": ("edge_plausibility", "detour", "id"),
    "elevation_deltas_consistent": ("coverage_audit", "bad_delta", "line"),
    "segments_cover_lines": ("coverage_audit", "uncovered", "line"),
    "lines_anchor_to_nodes": ("anchor_audit", "true", "line"),
    "reverse_metrics_consistent": ("reverse_metrics", "true", "id"),
    "rise_controls": ("rise_controls", "not ok", "id"),
    "features_in_one_family": ("ambiguous_features", "true", "id"),
    "snapshots_agree": ("snapshot_audit", "true", "id"),
    "layers_as_declared": ("artifact_gate", "differs", "layer"),
}


def _sql() -> str:
    known = oracle_sql()
    one = lambda name, q: f"select '{name}' check_id, count(*) = 0 pass, count(*) failures, coalesce((select string_agg(k, ' ' order by k) from (select cast(id as varchar) k from ({q}) order by k limit 50)), '') sample from ({q})"
    audits = [one(name, f"select distinct {key} id from ({known[audit]}) where {where}") for name, (audit, where, key) in _AUDITS.items()]
    return f"select check_id, pass, failures, sample from ({known['graph_checks']}) union all " + " union all ".join(audits)


@query(_sql())
def full_report(spark, d):
    """Twenty-nine named checks over graph, layers, provenance and audits: whether each passes, how many keys fail it, and the first fifty of them."""
    known = queries()
    parts = {name: known[audit](spark, d).filter(where).select(F.col(key).alias("id")).distinct() for name, (audit, where, key) in _AUDITS.items()}
    return known["graph_checks"](spark, d).unionByName(contracts.checks(parts))
