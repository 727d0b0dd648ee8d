"""Contracts, reports, audits and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.functions import geo, provenance, records
from wayfold.operators import contracts
from wayfold.plans import bindings as B
from wayfold.plans import sqltext as Q
from wayfold.plans.registry import query
from wayfold.sources.layers import publication, table

_P = [
    "p_partkey id",
    "case p_partkey % 23 when 0 then '' when 1 then '  ' else 'OpenStreetMap' end provider",
    "case when p_partkey % 19 <> 0 then concat('node/', p_partkey) end element",
    "case p_partkey % 38 when 0 then 'doc' end document_ref",
    "case p_partkey % 6 when 0 then 'source_node' when 1 then 'source_centroid' when 2 then 'bounds_midpoint' when 3 then 'entrance_node' when 4 then 'geometry_mean' end method",
    "case p_partkey % 5 when 0 then 'other' when 1 then 'representative_point' when 2 then 'representative_point' else 'source_point' end position_type",
    "case p_partkey % 13 when 0 then -1e0 when 1 then cast('nan' as double) when 2 then 3.5e0 end accuracy",
    "case p_partkey % 7 when 0 then 'not_reported_by_source' when 1 then 'derived_representative_point' when 2 then 'EXACT survey' when 3 then '' else 'estimated' end status",
    "case p_partkey % 11 when 0 then '' when 1 then '2024-01-01T00:00:00Z' end retrieved_at",
    "case when p_partkey % 4 <> 0 then 'not kept' end retrieval_status",
    "case p_partkey % 17 when 0 then null else 'Copernicus DEM' end dataset",
    "case p_partkey % 9 when 0 then 0e0 when 1 then cast('inf' as double) else 90e0 end resolution",
    "case p_partkey % 8 when 0 then -2e0 end vertical_accuracy",
    "case when p_partkey % 10 <> 0 then 'points.json' end snapshot",
    "case p_partkey % 3 when 0 then p_size * 1e0 when 1 then case when p_partkey % 12 = 1 then -5e0 end end height",
    "case p_partkey % 3 when 0 then case when p_partkey % 2 = 0 then 'measured' else 'unknown_no_measurement_source' end else case when p_partkey % 5 <> 0 then 'unknown_no_measurement_source' else 'guess' end end height_status",
    "case when p_partkey % 3 = 0 and p_partkey % 7 <> 0 then case when p_partkey % 6 = 0 then 'terrain' else 'physical_height' end end measurement_kind",
    "case when p_partkey % 3 = 0 and p_partkey % 7 <> 0 then case when p_partkey % 9 = 0 then 'points.json' else 'survey.json' end end height_reference",
    "case when p_partkey % 41 <> 0 then 51.3e0 + p_partkey / 1e5 end lat",
    "case p_partkey % 43 when 0 then cast('nan' as double) else 9.4e0 end lng",
]
_T = lambda x: f"coalesce(trim({x}) <> '', false)"
_OK = lambda x: f"({x} is null or coalesce(isfinite({x}) and {x} >= 0, false))"
_IF = lambda a, b: f"(not coalesce({a}, false) or coalesce({b}, false))"
_SOURCE, _DERIVED = "('source_node', 'entrance_node', 'field_observation')", "('source_centroid', 'bounds_midpoint', 'geometry_mean', 'route_geometry_coordinate')"
_POSITION_SQL = {
    "position_provider": _T("provider"), "position_reference": f"({_T('element')} or {_T('document_ref')})", "position_method": _T("method"), "position_type": "position_type in ('source_point', 'representative_point')", "position_accuracy": _OK("accuracy"), "position_status": _T("status"),
    "exact_needs_number": _IF("contains(lower(status), 'exact')", "accuracy is not null"), "representative_not_from_source": _IF("position_type = 'representative_point'", f"not coalesce(method in {_SOURCE}, false)"), "representative_discloses": _IF("position_type = 'representative_point'", "not coalesce(status = 'not_reported_by_source', false)"),
    "source_not_derived": _IF("position_type = 'source_point'", f"not coalesce(method in {_DERIVED}, false)"), "entrance_is_source": _IF("method = 'entrance_node'", "position_type = 'source_point'"), "retrieved_at_text": f"(retrieved_at is null or {_T('retrieved_at')})", "retrieval_status": _IF("retrieved_at is null", _T("retrieval_status")),
}
_ELEVATION_SQL = {"elevation_provider": _T("provider"), "elevation_dataset": _T("dataset"), "elevation_resolution": "isfinite(resolution) and resolution > 0", "elevation_accuracy": _OK("vertical_accuracy"), "elevation_status": _T("status"), "elevation_snapshot": _T("snapshot"), "elevation_retrieved_at": f"(retrieved_at is null or {_T('retrieved_at')})"}
_HEIGHT_SQL = {
    "unknown_height_stays_unknown": "(height is not null or (coalesce(height_status = 'unknown_no_measurement_source', false) and measurement_kind is null))", "height_not_negative": _IF("height is not null", "isfinite(height) and height >= 0"), "height_has_source": _IF("height is not null", "measurement_kind is not null"),
    "height_is_physical": _IF("height is not null and measurement_kind is not null", "measurement_kind = 'physical_height'"), "height_not_from_terrain": _IF("height is not null and measurement_kind is not null", "not coalesce(height_reference = snapshot, false)"), "height_status": _IF("height is not null", f"{_T('height_status')} and height_status <> 'unknown_no_measurement_source'"),
}
_COORDINATE_SQL = {"lat_finite": "isfinite(lat)", "lng_finite": "isfinite(lng)", "elevation_finite": "isfinite(resolution)"}


def _report_sql(rules: dict[str, str]) -> str:
    return f"with p as (select {', '.join(_P)} from part) " + " union all ".join(f"select '{n}' rule, count(*) checked, count_if(not coalesce({r}, false)) failures, min(case when not coalesce({r}, false) then id end) first_failure from p" for n, r in rules.items())


def _entities(spark, d) -> DataFrame:
    p = table(spark, d, "part").selectExpr(*_P)
    struct = lambda **names: F.struct(*(F.col(c).alias(k) for k, c in names.items()))
    position = struct(provider="provider", element="element", document_ref="document_ref", method="method", position_type="position_type", accuracy="accuracy", status="status", retrieved_at="retrieved_at", retrieval_status="retrieval_status")
    elevation = struct(provider="provider", dataset="dataset", resolution="resolution", accuracy="vertical_accuracy", status="status", snapshot="snapshot", retrieved_at="retrieved_at")
    height = F.when(F.col("measurement_kind").isNotNull(), struct(measurement_kind="measurement_kind", reference="height_reference"))
    return p.select("id", "lat", "lng", "height", "height_status", F.col("resolution").alias("elevation_m"), position.alias("position"), elevation.alias("elevation"), height.alias("height_source"))


@query(_report_sql(_POSITION_SQL))
def position_contract(spark, d):
    """Thirteen rules on where a position comes from: rows checked and broken, and the first that breaks each."""
    return contracts.report(_entities(spark, d), provenance.position_rules(F.col("position")), "id")


@query(_report_sql(_ELEVATION_SQL))
def elevation_contract(spark, d):
    """Seven rules on where an elevation comes from."""
    return contracts.report(_entities(spark, d), provenance.elevation_rules(F.col("elevation")), "id")


@query(_report_sql(_HEIGHT_SQL))
def height_contract(spark, d):
    """Six rules on physical heights, which are never read off terrain."""
    return contracts.report(_entities(spark, d), provenance.height_rules(*(F.col(c) for c in ("height", "height_status", "height_source", "elevation"))), "id")


_ALL = _COORDINATE_SQL | _POSITION_SQL | _ELEVATION_SQL | _HEIGHT_SQL


@query(f"with p as (select {', '.join(_P)} from part) " + " union all ".join(f"select id, '{n}' rule from p where not coalesce({r}, false)" for n, r in _ALL.items()))
def entity_contract(spark, d):
    """Every rule that each entity breaks, of coordinates, position, elevation and height together."""
    c = F.col
    rules = provenance.coordinate_rules(c("lat"), c("lng"), c("elevation_m")) | provenance.position_rules(c("position")) | provenance.elevation_rules(c("elevation")) | provenance.height_rules(c("height"), c("height_status"), c("height_source"), c("elevation"))
    return contracts.failing(_entities(spark, d), rules, "id")


_METRICS = ("distance_m", "ascent_m", "walking_min")
_DEFINED = ["c_custkey profile", "case when c_custkey % 4 <> 0 then case c_custkey % 3 when 0 then 'derived' when 1 then 'measured' else 'derived_summary' end end kind", "case when c_custkey % 5 <> 0 then 'sum of segments' end algorithm", "case c_custkey % 6 when 0 then '' when 1 then 'a, ' else 'a,b' end fields", "case when c_custkey % 7 <> 0 then 'flat' else ' ' end assumptions"]


@query(f"""with n as (select {', '.join(_DEFINED)} from customer), m as (select n.*, metric, not (metric = 'ascent_m' and profile % 8 = 0) defined from n, (values {', '.join(f"('{m}')" for m in _METRICS)}) v(metric))
 select profile, metric, 'definition' rule from m where not defined union all select profile, metric, 'kind' from m where not defined or not coalesce(kind in ('derived', 'derived_summary', 'source_qualified_derived'), false)
 union all select profile, metric, 'algorithm' from m where not defined or not {_T('algorithm')} union all select profile, metric, 'source_fields' from m where not defined or fields = '' or fields = 'a, ' union all select profile, metric, 'assumptions' from m where not defined or not {_T('assumptions')}""")
def metric_contract(spark, d):
    """For each profile the required metrics that it doesn't define well, and how."""
    n = table(spark, d, "customer").selectExpr(*_DEFINED)
    fields = F.when(F.col("fields") == "", F.array().cast("array<string>")).otherwise(F.split("fields", ","))
    definition = F.struct("kind", "algorithm", fields.alias("source_fields"), "assumptions")
    held = F.map_from_entries(F.array(*(F.struct(F.when((F.lit(m) == "ascent_m") & (F.col("profile") % 8 == 0), f"no {m}").otherwise(m).alias("k"), definition.alias("v")) for m in _METRICS)))
    required = n.select("profile", held.alias("metrics"), F.explode(F.array(*map(F.lit, _METRICS))).alias("metric"))
    required = required.withColumn("m", F.try_element_at("metrics", F.col("metric")))
    return required.select("profile", "metric", F.explode(contracts.broken(provenance.metric_rules(F.col("m")))).alias("rule"))


_PLACE = "case method when 'source_node' then position_type = 'source_point' and status = 'not_reported_by_source' when 'source_centroid' then position_type = 'representative_point' and status = 'derived_representative_point' when 'bounds_midpoint' then position_type = 'representative_point' and status = 'derived_representative_point' when 'geometry_mean' then position_type = 'representative_point' and status = 'derived_representative_point' end"


@query(f"with p as (select {', '.join(_P)} from part) select id from p where not coalesce({_PLACE}, false)")
def place_positions(spark, d):
    """Places whose kind of point and status aren't those of their method."""
    methods = spark.createDataFrame([v for v in records.METHODS.values()], "method string, want_type string, want_status string")
    p = _entities(spark, d).select("id", "position.*")
    # four rows
    j = p.join(F.broadcast(methods), "method", "left")
    return j.filter(~F.coalesce((F.col("position_type") == F.col("want_type")) & (F.col("status") == F.col("want_status")), F.lit(False))).select("id")


# -- audits of edges --------------------------------------------------------------------------------------------------------------------

_EDGE = f"(select e.id, src, dst, w, round({Q.distance('a', 'b')}, 1) straight, a.z az, b.z bz from {B.EDGES} e join {B.sql('nodes')} a on a.node = src join {B.sql('nodes')} b on b.node = dst)"


def _edges(spark, d) -> DataFrame:
    n = B.shape(spark, d, "nodes")
    e = B.graph_edges(spark, d).select("id", "src", "dst", "w")
    j = e.join(n.select(F.col("node").alias("src"), F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"), F.col("z").alias("az")), "src").join(n.select(F.col("node").alias("dst"), F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng"), F.col("z").alias("bz")), "dst")
    return j.withColumn("straight", F.round(geo.haversine(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng")), 1))


@query(f"select id, straight, w + 2 < straight too_short, w > greatest(2500, straight * 5 + 250) detour from {_EDGE} where w + 2 < straight or w > greatest(2500, straight * 5 + 250)")
def edge_plausibility(spark, d):
    """Edges shorter than the straight line, and detours to look at."""
    e = _edges(spark, d).withColumn("too_short", F.col("w") + 2 < F.col("straight")).withColumn("detour", F.col("w") > F.greatest(F.lit(2500.0), F.col("straight") * 5 + 250))
    return e.filter("too_short or detour").select("id", "straight", "too_short", "detour")


_COVER = f"""(select line, sum(d) covered, round(max(d) * 3, 1) declared, arg_max(z, pos) - arg_min(z, pos) delta, count(*) n, arg_min(lat, pos) lat, arg_min(lng, pos) lng, min(node) node from {B.sql('polylines')} group by line)"""


@query(f"select line, abs(covered - declared) > 3 uncovered, abs(delta - 5 * (line % 3)) > 0.11 bad_delta from {_COVER} where abs(covered - declared) > 3 or abs(delta - 5 * (line % 3)) > 0.11")
def coverage_audit(spark, d):
    """Lines whose segments don't add up to the declared length within three metres, or whose elevations don't give the declared difference."""
    g = B.polylines(spark, d).groupBy("line").agg(F.sum("d").alias("covered"), F.round(F.max("d") * 3, 1).alias("declared"), (F.max_by("z", "pos") - F.min_by("z", "pos")).alias("delta"))
    g = g.select("line", (F.abs(F.col("covered") - F.col("declared")) > 3).alias("uncovered"), (F.abs(F.col("delta") - 5 * (F.col("line") % 3)) > 0.11).alias("bad_delta"))
    return g.filter("uncovered or bad_delta")


@query(f"select line, round({Q.distance('c', 'n')}, 1) off_m from {_COVER} c join {B.sql('nodes')} n on n.node = c.node where {Q.distance('c', 'n')} > 2")
def anchor_audit(spark, d):
    """Lines that don't begin within two metres of the node that they should."""
    v = B.polylines(spark, d).groupBy("line").agg(F.min_by("lat", "pos").alias("lat"), F.min_by("lng", "pos").alias("lng"), F.min("node").alias("node"))
    j = v.join(B.shape(spark, d, "nodes").select("node", F.col("lat").alias("n_lat"), F.col("lng").alias("n_lng")), "node")
    off = geo.haversine(F.col("lat"), F.col("lng"), F.col("n_lat"), F.col("n_lng"))
    return j.withColumn("off", off).filter("off > 2").select("line", F.round("off", 1).alias("off_m"))


@query(f"select a.id, b.id reverse_id from {B.SEGMENTS} a join {B.SEGMENTS} b on a.src = b.dst and a.dst = b.src and a.back <> b.back where abs(coalesce(a.ascent_m, 0) + case when a.src % 9 = 0 then 0.2 else 0.1 end - coalesce(b.descent_m, 0)) > 0.11 or a.distance_m <> b.distance_m")
def reverse_metrics(spark, d):
    """Pairs of opposite segments whose climbs or lengths don't mirror each other within 0.11."""
    a, b = B.segments(spark, d).alias("a"), B.segments(spark, d).alias("b")
    j = a.join(b, (F.col("a.src") == F.col("b.dst")) & (F.col("a.dst") == F.col("b.src")) & (F.col("a.back") != F.col("b.back")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    # what a revised model would give at every ninth node is off by more
    ascent = zero("a.ascent_m") + F.when(F.col("a.src") % 9 == 0, 0.2).otherwise(0.1)
    off = (F.abs(ascent - zero("b.descent_m")) > 0.11) | (F.col("a.distance_m") != F.col("b.distance_m"))
    return j.filter(off).select(F.col("a.id").alias("id"), F.col("b.id").alias("reverse_id"))


@query(f"select a.id, b.id nearest, b.d from (select c_custkey id from customer where c_custkey % 10 = 0) a left join (select c.id, round({Q.distance('c', 's')}, 3) d from {B.sql('customers')} c join {B.sql('suppliers')} s on s.id = c.id) b on b.id = a.id where b.d is null or b.d > 150")
def tolerance_audit(spark, d):
    """A cross-check by key: what has no counterpart, or one more than 150 m away."""
    c = B.customers(spark, d)
    s = B.suppliers(spark, d).select("id", F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"))
    near = c.join(s, "id").select(F.col("id").alias("nearest"), F.round(geo.haversine(F.col("lat"), F.col("lng"), F.col("s_lat"), F.col("s_lng")), 3).alias("d"))
    return c.filter("id % 10 = 0").select("id").join(near, F.col("id") == F.col("nearest"), "left").filter("d is null or d > 150").select("id", "nearest", "d")


# -- joins that fail, audits of rows ----------------------------------------------------------------------------------------------------


@query("select l_orderkey, count(*) n, round(sum(p_size), 0) total from lineitem join part on p_partkey = l_partkey group by l_orderkey")
def strict_lookup(spark, d):
    """A lookup that fails on a key without a match instead of dropping the row."""
    items = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    found = contracts.lookup(items, table(spark, d, "part").select("p_partkey", "p_size"), ["p_partkey"], "no part for item", "p_partkey")
    return found.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p_size").cast("double"), 0).alias("total"))


_DRIFT = "(select c_custkey id, c_nationkey + case when c_custkey % 17 = 0 then 1 else 0 end nation, c_name || case when c_custkey % 23 = 0 then 'x' else '' end name from customer where c_custkey % 29 <> 0 union all select -1, 0, 'extra')"


@query(f"select coalesce(a.c_custkey, b.id) id, case when b.id is null then 'missing' when a.c_custkey is null then 'extra' when a.c_nationkey <> b.nation then 'nation' else 'name' end fault from customer a full join {_DRIFT} b on b.id = a.c_custkey where b.id is null or a.c_custkey is null or a.c_nationkey <> b.nation or a.c_name <> b.name")
def snapshot_audit(spark, d):
    """Two snapshots row by row: what one hasn't got, and the first field that differs."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"))
    other = c.filter("id % 29 <> 0").select("id", (F.col("nation") + F.when(F.col("id") % 17 == 0, 1).otherwise(0)).alias("nation"), F.concat("name", F.when(F.col("id") % 23 == 0, "x").otherwise("")).alias("name"))
    other = other.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(0).alias("nation"), F.lit("extra").alias("name")))
    return contracts.row_differences(c, other, "id", ["nation", "name"])


@query("select l_orderkey from (select l_orderkey, l_partkey = lag(l_suppkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) c, count(*) over (partition by l_orderkey) n from (select l_orderkey, l_linenumber, l_partkey % 2 l_partkey, l_suppkey % 2 l_suppkey from lineitem)) group by l_orderkey having bool_and(coalesce(c, true))")
def contiguous_chains(spark, d):
    """Groups whose steps each begin where the one before ended."""
    v = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 2).alias("l_partkey"), (F.col("l_suppkey") % 2).alias("l_suppkey"))
    before = F.lag("l_suppkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return v.withColumn("joined", F.coalesce(F.col("l_partkey") == before, F.lit(True))).groupBy("l_orderkey").agg(F.bool_and("joined").alias("all_joined")).filter("all_joined").select("l_orderkey")


@query("select o_custkey id, max(cast(substr(o_orderpriority, 1, 1) as bigint)) latest_version, max(cast(o_orderdate as varchar)) latest, arg_min(o_orderkey, (o_orderdate, o_orderkey)) first_order from orders group by o_custkey")
def latest_versions(spark, d):
    """The highest version as a number, the latest time stamp, and the first match in order."""
    o = table(spark, d, "orders")
    date = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return o.groupBy(F.col("o_custkey").alias("id")).agg(F.max(F.substring("o_orderpriority", 1, 1).try_cast("bigint")).alias("latest_version"), F.max(date).alias("latest"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


@query("with s as (select o_custkey, o_orderpriority s, min(o_orderkey) first from orders group by all) select o_custkey id, string_agg(s, ', ' order by first) seen from s group by o_custkey")
def first_seen_lists(spark, d):
    """Each group's different values in the order in which they were first seen."""
    s = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("first"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first", "o_orderpriority"))), lambda x: x["o_orderpriority"])
    return s.groupBy(F.col("o_custkey").alias("id")).agg(F.array_join(ordered, ", ").alias("seen"))


# -- reports and gates --------------------------------------------------------------------------------------------------------------------


def _bad_sql(parts: dict[str, str]) -> str:
    return " union all ".join(f"select '{n}' check_id, count(*) = 0 pass, count(*) failures, coalesce((select string_agg(k, ' ' order by k) from (select cast(id as varchar) k from ({q}) order by k limit 50)), '') sample from ({q})" for n, q in parts.items())


_NODES, _EDGES = B.sql("nodes"), B.EDGES
_GRAPH_SQL = {
    "place_coordinates_in_research_bbox": f"select node id from {_NODES} where not (lat between 51.307 and 51.3225 and lng between 9.385 and 9.425)",
    "place_elevations_present": f"select node id from {_NODES} where z is null",
    "edge_references_exist": f"select id from {_EDGES} where src not in (select node from {_NODES}) or dst not in (select node from {_NODES})",
    "no_duplicate_directed_edges": f"select concat(src, '>', dst) id from {_EDGES} group by src, dst having count(*) > 1",
    "bidirectional_edges": f"select a.id from {B.SEGMENTS} a where not exists (select 1 from {B.SEGMENTS} b where b.src = a.dst and b.dst = a.src)",
    "no_self_loops": f"select id from {_EDGES} where src = dst",
    "edge_distances_not_shorter_than_geodesic": f"select id from {_EDGE} where w + 2 < straight",
    "unique_item_keys": "select concat(l_orderkey, '/', l_linenumber) id from lineitem group by l_orderkey, l_linenumber having count(*) > 1",
    "orders_have_items": "select o_orderkey id from orders where o_orderkey not in (select l_orderkey from lineitem)",
    "required_relations_present": "select n_nationkey id from nation where n_nationkey not in (select c_nationkey from customer where c_mktsegment = 'BUILDING')",
    "entity_ids_unique": "select id from (select concat('n', n_nationkey) id from nation union all select concat('n', r_regionkey) from region) group by id having count(*) > 1",
    "declared_counts": "select * from (select 'customer' id, count(*) n from customer union all select 'supplier', count(*) * 10 from supplier) where (id = 'customer') <> (n = (select count(*) from customer)) or id = 'customer' and n <> (select count(*) from customer)",
}


@query(_bad_sql(_GRAPH_SQL).replace("select * from (select 'customer' id, count(*) n", "select id from (select 'customer' id, count(*) n"))
def graph_checks(spark, d):
    """A row for each of twelve named checks over graph and layers, with how many rows fail and the first fifty of them."""
    nodes, edges, segments = B.shape(spark, d, "nodes"), B.graph_edges(spark, d), B.segments(spark, d)
    t = lambda n: table(spark, d, n)
    unknown = lambda end: edges.join(nodes, F.col(end) == F.col("node"), "left_anti")
    reverse = segments.select(F.col("src").alias("dst"), F.col("dst").alias("src")).distinct()
    box = geo.in_box(F.col("lat"), F.col("lng"), (51.307, 9.385, 51.3225, 9.425))
    ids = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id")).union(t("region").select(F.concat(F.lit("n"), "r_regionkey")))
    building = t("customer").filter("c_mktsegment = 'BUILDING'")
    counts = t("customer").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_custkey").alias("declared"))
    twice = lambda df, *by: df.groupBy(*by).count().filter("count > 1")
    return contracts.checks({
        "place_coordinates_in_research_bbox": nodes.filter(~box).select(F.col("node").alias("id")),
        "place_elevations_present": nodes.filter("z is null").select(F.col("node").alias("id")),
        "edge_references_exist": unknown("src").select("id").union(unknown("dst").select("id")).distinct(),
        "no_duplicate_directed_edges": twice(edges, "src", "dst").select(F.concat_ws(">", "src", "dst").alias("id")),
        "bidirectional_edges": segments.join(reverse, ["src", "dst"], "left_anti").select("id"),
        "no_self_loops": edges.filter("src = dst").select("id"),
        "edge_distances_not_shorter_than_geodesic": _edges(spark, d).filter("w + 2 < straight").select("id"),
        "unique_item_keys": twice(t("lineitem"), "l_orderkey", "l_linenumber").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("id")),
        "orders_have_items": t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.col("o_orderkey").alias("id")),
        "required_relations_present": t("nation").join(building, F.col("n_nationkey") == F.col("c_nationkey"), "left_anti").select(F.col("n_nationkey").alias("id")),
        "entity_ids_unique": twice(ids, "id").select("id"),
        "declared_counts": counts.filter("n <> declared").select(F.lit("customer").alias("id")),
    })


_LAYER = ["c_custkey id", "case when c_custkey % 9 = 0 then '/abs.json' when c_custkey % 8 = 0 then 'a/../b.json' when c_custkey % 7 = 0 then '' else concat('layer-', c_custkey, '.json') end filename", "case c_custkey % 5 when 0 then 'initial' when 1 then 'hydrate' when 2 then 'deferred' else 'later' end load_phase", "c_custkey % 6 = 0 boot_required", "case c_custkey % 4 when 0 then 'walking-network' when 1 then 'zip' else 'copy' end producer", "case when c_custkey % 3 <> 0 then 'schema_version' end field"]
_CONTRACT = {"safe_filename": "filename <> '' and not startswith(filename, '/') and not contains(filename, '..')", "known_phase": "load_phase in ('initial', 'hydrate', 'deferred')", "known_producer": "producer in ('copy', 'walking-network')", "boot_is_initial": "not boot_required or load_phase = 'initial'", "schema_declared": "field is not null"}


@query(f"with p as (select {', '.join(_LAYER)} from customer) " + " union all ".join(f"select '{n}' rule, count(*) checked, count_if(not coalesce({r.replace('startswith', 'starts_with')}, false)) failures, min(case when not coalesce({r.replace('startswith', 'starts_with')}, false) then id end) first_failure from p" for n, r in _CONTRACT.items()))
def runtime_contract(spark, d):
    """What a manifest's layers must declare, safe paths among it."""
    return contracts.report(table(spark, d, "customer").selectExpr(*_LAYER), {n: F.expr(r) for n, r in _CONTRACT.items()}, "id")


_HELD = ["c_custkey device", "layer", "c_custkey % 3 <> 0 or layer <> 'trees' available", "c_custkey % 4 <> 0 or layer = 'nodes' precache"]
_WANTED = ("nodes", "trees", "benches", "semantic")
_READY = f"""(select w.device, w.layer, m.device is not null declared, coalesce(m.available, false) available, coalesce(m.precache, false) precache from (select c_custkey device, layer from customer, (values {", ".join(f"('{x}')" for x in _WANTED)}) v(layer)) w
 left join (select {", ".join(_HELD)} from customer, (values ('nodes'), ('trees'), ('benches'), ('semantic')) v(layer) where c_custkey % 5 <> 0 or layer <> 'benches') m using (device, layer))"""


@query(f"select device, layer, declared, available, precache, case when bool_and(declared and available and precache) over (partition by device) then 'ready-after-warm' else 'partial' end state from {_READY}")
def offline_readiness(spark, d):
    """Which wanted layers each device's manifest declares, has and keeps at hand, and whether that is all of them."""
    layers = F.explode(F.array(*map(F.lit, _WANTED))).alias("layer")
    every = table(spark, d, "customer").select("c_custkey", layers)
    manifest = every.filter("c_custkey % 5 <> 0 or layer <> 'benches'").selectExpr(*_HELD).withColumnRenamed("layer", "id")
    return contracts.readiness(every.select(F.col("c_custkey").alias("device"), "layer"), manifest, by=["device"])


@query("""select layer, n_rows, required, case when n_rows is null then 'unavailable' else 'ready' end status from (select 'customer' layer, (select count(*) from customer) n_rows, true required union all select 'orders', (select count(*) from orders), true union all select 'trees', null, false)""")
def layer_status(spark, d):
    """A set of layers, those that aren't there and needn't be marked unavailable, the others counted."""
    return publication(spark, d, {"customer": True, "orders": True, "trees": False}).select("layer", "n_rows", "required", "status")


@query("select layer, expected, actual, expected is null or actual is null or expected <> actual differs from (select 'customer' layer, (select count(*) from customer) expected, (select count(*) from customer) actual union all select 'supplier', (select count(*) from supplier) + 1, (select count(*) from supplier) union all select 'orders', null, (select count(*) from orders) union all select 'ghost', 5, null)")
def artifact_gate(spark, d):
    """Declared against actual row counts of published layers, what is missing on either side included."""
    actual = None
    for name in ("customer", "supplier", "orders"):
        one = table(spark, d, name).agg(F.count(F.lit(1)).alias("actual")).select(F.lit(name).alias("layer"), "actual")
        actual = one if actual is None else actual.unionByName(one)
    expected = actual.filter("layer <> 'orders'").select("layer", (F.col("actual") + F.when(F.col("layer") == "supplier", 1).otherwise(0)).alias("expected")).unionByName(spark.createDataFrame([("ghost", 5)], "layer string, expected long"))
    return contracts.gate(expected, actual, "layer")


@query("""with a as (select o_orderkey k, concat_ws('|', o_orderkey, o_custkey, o_orderpriority) t from orders), b as (select k // 1000 k, sha256(string_agg(t, chr(10) order by k)) t from a group by 1), c as (select k // 1000 k, sha256(string_agg(t, chr(10) order by k)) t from b group by 1),
 e as (select k // 1000 k, sha256(string_agg(t, chr(10) order by k)) t from c group by 1) select sha256(string_agg(t, chr(10) order by k)) selection_sha256, (select count(*) from orders) n from e""")
def selection_hash(spark, d):
    """A digest over a selection's rows in order, to which what is derived from them is bound."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderpriority").alias("t"))
    # one row
    return contracts.ordered_digest(rows, "k", "t").withColumnRenamed("sha256", "selection_sha256")


@query("select strftime(make_timestamp((1700000000 + c_custkey)::bigint * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') generated_at, c_custkey id from customer where c_custkey % 3 <> 0 union all select null, c_custkey from customer where c_custkey % 3 = 0")
def release_times(spark, d):
    """Deterministic time stamps from an epoch that is given as text, null without one."""
    epoch = F.when(F.col("c_custkey") % 3 != 0, (F.lit(1700000000) + F.col("c_custkey")).cast("string"))
    return table(spark, d, "customer").select(contracts.release_time(epoch).alias("generated_at"), F.col("c_custkey").alias("id"))



_POI = ["c_custkey id", "case c_custkey % 9 when 0 then 'toilet' when 1 then 'access' when 2 then 'kiosk' else 'artwork' end family", "case when c_custkey % 4 = 0 then 'way' when c_custkey % 31 = 0 then 'relation' else 'node' end element_type", "case when c_custkey % 8 = 0 then 'source_node' when c_custkey % 4 = 0 then 'bounds_midpoint' else 'source_node' end method", "case when c_custkey % 4 = 0 then 'representative_point' else 'source_point' end position_type", "case when c_custkey % 6 <> 0 then '3' end version", "c_custkey % 10 <> 0 tagged", "case c_custkey % 7 when 0 then 'somewhere' else 'inside_park' end relation", "case when c_custkey % 11 = 0 then 3e0 end height", "case when c_custkey % 13 <> 0 then 'r' end source_ref"]
_POI_RULES = {
    "family_known": "family in ('access', 'toilet', 'drinking_water', 'viewpoint', 'shelter', 'transit', 'artwork')",
    "element_known": "element_type in ('node', 'way')",
    "element_version": "version is not null",
    "method_of_element": "method = case element_type when 'node' then 'source_node' else 'bounds_midpoint' end",
    "type_of_element": "position_type = case element_type when 'node' then 'source_point' else 'representative_point' end",
    "scope_known": "relation in ('inside_park', 'boundary_external', 'external_relevant')",
    "height_unknown": "height is null",
    "source_named": "source_ref is not null",
    "access_is_tagged_node": "family <> 'access' or (element_type = 'node' and position_type = 'source_point' and tagged)",
}


@query(f"with p as (select {', '.join(_POI)} from customer) " + " union all ".join(f"select '{n}' rule, count(*) checked, count_if(not coalesce({r}, false)) failures, min(case when not coalesce({r}, false) then id end) first_failure from p" for n, r in _POI_RULES.items()))
def feature_contract(spark, d):
    """Nine rules on visitor features: family, element, how the point was derived, scope, height and sources."""
    return contracts.report(table(spark, d, "customer").selectExpr(*_POI), {n: F.expr(r) for n, r in _POI_RULES.items()}, "id")


_TERRAIN = ["c_custkey id", "case c_custkey % 6 when 0 then 'png' else 'maplibre-raster-dem-terrarium-v1' end format", "case c_custkey % 7 when 0 then 512 else 256 end tile_size", "case c_custkey % 5 when 0 then '13,14' else '13,14,15,16' end zooms", "60 + case c_custkey % 8 when 0 then 1 else 0 end tile_count", "4817250 + c_custkey * 200000 tile_bytes", "case c_custkey % 9 when 0 then 'feet' else 'metres' end units", "9.385e0 west", "case c_custkey % 10 when 0 then 9.3e0 else 9.425e0 end east"]
_TERRAIN_RULES = {"format": "format = 'maplibre-raster-dem-terrarium-v1'", "tile_size": "tile_size = 256", "zooms": "zooms = '13,14,15,16'", "tiles": "tile_count = 60", "bytes": "tile_bytes <= 8388608", "units": "units = 'metres'", "bounds": "west < east"}


@query(f"with p as (select {', '.join(_TERRAIN)} from customer) " + " union all ".join(f"select '{n}' rule, count(*) checked, count_if(not coalesce({r}, false)) failures, min(case when not coalesce({r}, false) then id end) first_failure from p" for n, r in _TERRAIN_RULES.items()))
def terrain_contract(spark, d):
    """Seven rules on what a pyramid of terrain tiles declares."""
    return contracts.report(table(spark, d, "customer").selectExpr(*_TERRAIN), {n: F.expr(r) for n, r in _TERRAIN_RULES.items()}, "id")


_TREES = {"ids": "id is not null", "catalogue_number": "length(brand) >= 7", "species": "kind is not null and kind <> ''", "in_bounds": "lat between 51.307 and 51.323 and lng between 9.385 and 9.425", "girth_positive": "girth is null or girth > 0", "not_pending": "id % 97 <> 0"}
_TREE = ["node id", "lat", "lng", "case when node % 12 = 0 then 0 when node % 5 <> 0 then node % 50 + 1 end girth", "case when node % 15 <> 0 then 'Quercus' else '' end kind", "case when node % 18 <> 0 then 'Brand#1' else 'x' end brand"]


@query(f"with p as (select {', '.join(_TREE)} from {B.sql('nodes')}) " + " union all ".join(f"select '{n}' rule, count(*) checked, count_if(not coalesce({r}, false)) failures, min(case when not coalesce({r}, false) then id end) first_failure from p" for n, r in _TREES.items()))
def tree_contract(spark, d):
    """Six rules on trees: numbers, species, bounds, girth and state."""
    return contracts.report(B.shape(spark, d, "nodes").selectExpr(*_TREE), {n: F.expr(r) for n, r in _TREES.items()}, "id")
