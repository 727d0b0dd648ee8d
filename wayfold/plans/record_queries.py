"""Records: from raw elements and tags to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo, normalize, records
from wayfold.operators import graph, sequences, spatial
from wayfold.plans import bindings as B
from wayfold.plans import sqltext as Q
from wayfold.plans.registry import query

_C = B.sql("customers")


def _pick(k: int) -> Column:
    return F.col("id") % 5 == k


_POINT = f"""(select id, case id % 5 when 0 then lat when 1 then lat + 0.001e0 when 2 then (lat - 0.002e0 + (lat + 0.004e0)) / 2 when 3 then (0e0 + lat + (lat + 0.001e0) + (lat + 0.003e0)) / 3 end lat,
 case id % 5 when 0 then lng when 1 then lng - 0.001e0 when 2 then (lng - 0.002e0 + (lng + 0.006e0)) / 2 when 3 then (0e0 + lng + (lng + 0.001e0) + (lng + 0.003e0)) / 3 end lng, case id % 5 when 0 then 'osm_node' when 1 then 'osm_center' when 2 then 'osm_bounds_midpoint' when 3 then 'osm_geometry_mean' end method from {_C})"""


@query(f"""select id, round(lat, 7) lat, round(lng, 7) lng, method coordinate_method, case method when 'osm_node' then 'source_node' when 'osm_center' then 'source_centroid' when 'osm_bounds_midpoint' then 'bounds_midpoint' when 'osm_geometry_mean' then 'geometry_mean' end method,
 case when method = 'osm_node' then 'source_point' when method is not null then 'representative_point' end position_type, case when method = 'osm_node' then 'not_reported_by_source' when method is not null then 'derived_representative_point' end accuracy_status,
 case when id % 5 in (0, 2) then 'high' else 'medium' end confidence from {_POINT}""")
def place_records(spark, d):
    """A representative point for each element by what it has, with its derivation and provenance."""
    p = B.customers(spark, d)
    at = lambda dy, dx: F.struct((F.col("lat") + dy).alias("lat"), (F.col("lng") + dx).alias("lng"))
    box = F.struct((F.col("lat") - 0.002).alias("south"), (F.col("lng") - 0.002).alias("west"), (F.col("lat") + 0.004).alias("north"), (F.col("lng") + 0.006).alias("east"))
    point = records.representative_point(F.when(_pick(0), at(0.0, 0.0)), F.when(_pick(1), at(0.001, -0.001)), F.when(_pick(2), box), F.when(_pick(3), F.array(at(0.0, 0.0), at(0.001, 0.001), at(0.003, 0.003))))
    p = p.withColumn("p", point).withColumn("s", records.position_source(F.col("p.method")))
    confidence = F.when((F.col("id") % 5).isin(0, 2), "high").otherwise("medium")
    return p.select("id", F.round("p.lat", 7).alias("lat"), F.round("p.lng", 7).alias("lng"), F.col("p.method").alias("coordinate_method"), "s.method", "s.position_type", "s.accuracy_status", confidence.alias("confidence"))


_ONEWAY = """case when coalesce(oneway_foot, foot_oneway) is not null then case when lower(trim(coalesce(oneway_foot, foot_oneway))) in ('yes', '1', 'true') then 'forward' when lower(trim(coalesce(oneway_foot, foot_oneway))) in ('-1', 'reverse') then 'reverse' else 'both' end
 when highway = 'steps' and conveying = 'forward' then 'forward' when highway = 'steps' and conveying = 'backward' then 'reverse' else 'both' end"""


@query(f"select id, o oneway, o in ('both', 'forward') forward_allowed, o in ('both', 'reverse') reverse_allowed from (select id, {_ONEWAY} o from {B.sql('tags')})")
def oneway_policies(spark, d):
    """Which way pedestrians may walk, by the tags that speak of them."""
    c = F.col
    t = B.shape(spark, d, "tags").select("id", normalize.pedestrian_oneway(c("oneway_foot"), c("foot_oneway"), c("highway"), c("conveying")).alias("oneway"))
    return t.select("id", "oneway", normalize.direction_allowed(c("oneway"), F.lit("forward")).alias("forward_allowed"), normalize.direction_allowed(c("oneway"), F.lit("reverse")).alias("reverse_allowed"))


_REFS = f"(select line, list(node order by pos) refs from {B.sql('polylines')} group by line)"


def _refs(spark, d) -> DataFrame:
    # a line's nodes, the vertices of one order
    return B.polylines(spark, d).groupBy("line").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("refs"))


_ENDS = ("case line % 3 when 0 then refs[1] when 1 then refs[len(refs)] else refs[1] end", "case line % 3 when 0 then refs[2] when 1 then refs[len(refs) - 1] else -5 end")


@query(f"""with r as (select line, refs, {_ENDS[0]} a, {_ENDS[1]} b from {_REFS}), p as (select line, a, b, refs[i] x, refs[i + 1] y, i from (select *, unnest(range(1, len(refs))) i from r)),
 h as (select line, arg_min(case when x = a and y = b then 'forward' else 'reverse' end, i) d from p where (x = a and y = b) or (x = b and y = a) group by line)
 select r.line, coalesce(d, 'unknown') direction from r left join h using (line)""")
def traversal_directions(spark, d):
    """How a way passes a pair of its nodes."""
    r = _refs(spark, d)
    n = F.size("refs")
    kind = F.col("line") % 3
    a = F.when(kind == 1, F.element_at("refs", -1)).otherwise(F.get("refs", F.lit(0)))
    b = F.when(kind == 0, F.get("refs", F.lit(1))).when(kind == 1, F.get("refs", n - 2)).otherwise(F.lit(-5))
    return r.select("line", normalize.traversal_direction(F.col("refs"), a, b).alias("direction"))


_INCLINE = "case node % 4 when 0 then 'up' when 1 then '12%' when 2 then '-3' end"
_DIRECTION = "case node % 3 when 0 then 'forward' when 1 then 'reverse' else 'unknown' end"


@query(f"""with s as (select line, pos, coalesce(surface, '-') surface, {_INCLINE} incline, case {_DIRECTION} when 'forward' then 'reverse' when 'reverse' then 'forward' else 'unknown' end direction from {B.sql('polylines')})
 select line, string_agg(concat_ws(' ', surface, direction, coalesce(case direction when 'forward' then incline when 'reverse' then case incline when 'up' then 'down' when '12%' then '-12%' when '-3' then '3' end end, '-')), ', ' order by pos desc) segments from s group by line""")
def reversed_segments(spark, d):
    """Each line's segments walked the other way."""
    v = B.polylines(spark, d).selectExpr("line", "pos", "coalesce(surface, '-') surface", f"{_INCLINE} incline", f"{_DIRECTION} direction", "cast(null as string) route_incline")
    s = v.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("pos", "surface", "incline", "direction", "route_incline"))).alias("s"))
    text = lambda x: F.concat_ws(" ", x["surface"], x["direction"], F.coalesce(x["route_incline"], F.lit("-")))
    return s.select("line", F.array_join(F.transform(normalize.reverse_segments(F.col("s")), text), ", ").alias("segments"))


@query(f"""select e.id, round(b.z - a.z, 1) delta, case when w >= 90 then round(greatest(b.z - a.z, 0), 1) end ascent, case when w >= 90 then round(greatest(a.z - b.z, 0), 1) end descent, case when w >= 90 then round((b.z - a.z) / w * 100, 1) end grade,
 case when w >= 90 then 'coarse_glo90_endpoint_estimate' else 'below_dem_horizontal_resolution' end status, cast(greatest(1, round_even(w / (5000 / 60::double) + greatest(b.z - a.z, 0) / 10, 0)) as int) walk_min from {B.EDGES} e join {B.sql('nodes')} a on a.node = src join {B.sql('nodes')} b on b.node = dst""")
def segment_terrain(spark, d):
    """Climbs and grades of segments, null below the elevation model's resolution, and walking times."""
    z = B.shape(spark, d, "nodes").select("node", "z")
    e = B.graph_edges(spark, d).join(z.toDF("src", "za"), "src").join(z.toDF("dst", "zb"), "dst")
    t = normalize.terrain_metrics(F.col("za"), F.col("zb"), F.col("w"))
    minutes = geo.walking_minutes(F.col("w"), F.greatest(F.col("zb") - F.col("za"), F.lit(0.0)))
    return e.select("id", t.alias("t"), minutes.alias("walk_min")).select("id", "t.*", "walk_min")


@query(f"""select id, src, dst, ascent, descent, delta, grade from (select id, src, dst, p_size % 9 ascent, p_size % 5 descent, p_size % 9 - p_size % 5 delta, w / 10e0 grade from {B.EDGES} union all
 select id, dst, src, p_size % 5, p_size % 9, p_size % 5 - p_size % 9, -w / 10e0 from {B.EDGES})""")
def mirrored_edges(spark, d):
    """Each edge both ways, the reverse with ascent and descent swapped and delta and grade negated."""
    e = B._edges_with_size(spark, d).selectExpr("id", "src", "dst", "p_size % 9 ascent", "p_size % 5 descent", "p_size % 9 - p_size % 5 delta", "w / 10e0 grade")
    return graph.mirrored(e)


_KEY = "cast(round(round({c}, 3) * 1e7) as bigint)"


@query(f"""with n as (select node, {_KEY.format(c='lat')} y, {_KEY.format(c='lng')} x, round(lat, 3) lat, round(lng, 3) lng from {B.sql('nodes')}), p as (select id, {_KEY.format(c='lat')} y, {_KEY.format(c='lng')} x from {B.sql('suppliers')}),
 o as (select y, x, min(node) osm, count(*) n, any_value(lat) lat, any_value(lng) lng from n group by all), q as (select y, x, min(id) place, count(*) n from p group by all)
 select o.y lat7, o.x lng7, o.n nodes, coalesce(q.n, 0) places, case when q.place is not null then concat('pathnode-place-', q.place) when o.osm % 2 = 0 then concat('pathnode-osm-', o.osm) else concat('pathnode-coordinate-', substr(sha1(printf('%.7f,%.7f', o.lat, o.lng)), 1, 12)) end name from o left join q on q.y = o.y and q.x = o.x""")
def path_node_names(spark, d):
    """Nodes at one coordinate become one path node, named by its place, else its map node, else the coordinate."""
    coarse = lambda df, ident: df.select(F.col(ident).alias("k"), F.round("lat", 3).alias("lat"), F.round("lng", 3).alias("lng"))
    keyed = lambda df: df.select("*", *(c.alias(n) for c, n in zip(geo.coordinate_key(F.col("lat"), F.col("lng")), ("lat7", "lng7"))))
    nodes = keyed(coarse(B.shape(spark, d, "nodes"), "node")).groupBy("lat7", "lng7").agg(F.min("k").alias("osm"), F.count(F.lit(1)).alias("nodes"), F.first("lat").alias("lat"), F.first("lng").alias("lng"))
    places = keyed(coarse(B.suppliers(spark, d), "id")).groupBy("lat7", "lng7").agg(F.min("k").alias("place"), F.count(F.lit(1)).alias("places"))
    j = nodes.join(places, ["lat7", "lng7"], "left")
    name = normalize.node_name(F.col("place").cast("string"), F.when(F.col("osm") % 2 == 0, F.col("osm")), F.col("lat"), F.col("lng"))
    return j.select("lat7", "lng7", "nodes", F.coalesce("places", F.lit(0)).alias("places"), name.alias("name"))


@query(f"""select line, count(*) n, string_agg(concat(v.node, ' ', coalesce(barrier, '-'), ' ', coalesce(access, '-'), ' ', coalesce(foot, '-')), ', ' order by pos) evidence from {B.sql('polylines')} v join {B.sql('nodes')} n on n.node = v.node
 where barrier is not null or access is not null or foot is not null group by line""")
def barrier_evidence(spark, d):
    """Along each line the nodes that say something of barriers or access, in order."""
    nodes = B.shape(spark, d, "nodes").filter("barrier is not null or access is not null or foot is not null")
    at = B.polylines(spark, d).select("line", "pos", "node").join(nodes, "node")
    text = F.concat_ws(" ", F.col("node").cast("string"), *(F.coalesce(c, F.lit("-")) for c in ("barrier", "access", "foot")))
    rows = F.array_sort(F.collect_list(F.struct("pos", text.alias("t"))))
    return at.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(rows, lambda r: r["t"]), ", ").alias("evidence"))


_POI_TAGS = ["case id % 9 when 0 then 'toilets' when 1 then 'drinking_water' when 2 then 'shelter' end amenity", "case id % 14 when 3 then 'yes' end drinking_water", "case id % 7 when 0 then 'viewpoint' when 4 then 'artwork' end tourism", "case id % 11 when 5 then 'platform' end public_transport", "case id % 13 when 6 then 'main' end entrance", "case id % 17 when 7 then 'gate' end barrier", "id % 3 = 0 named", "id % 49 = 0 known_view"]
_POI = f"(select *, {Q.in_ring('lat', 'lng')} inside, {Q.ring_distance('lat', 'lng')} m from (select id, lat, lng, {', '.join(_POI_TAGS)} from {_C}))"
_FAMILY = "case when coalesce(amenity = 'toilets', false) and (inside or m <= 100) then 'toilet' when (coalesce(amenity = 'drinking_water', false) or coalesce(drinking_water = 'yes', false)) and inside then 'drinking_water' when coalesce(tourism = 'viewpoint', false) and (inside or known_view) then 'viewpoint' when coalesce(amenity = 'shelter', false) and inside then 'shelter' when coalesce(tourism = 'artwork', false) and inside then 'artwork' when coalesce(public_transport = 'platform', false) and named then 'transit' end"
_SELECTED = f"""(select id, family, case when inside then 'inside_park' when family = 'viewpoint' and known_view then 'external_relevant' else 'boundary_external' end relation, round(m, 1) boundary_m from (
 select *, 'access' family from {_POI} where (entrance is not null or barrier is not null) and (inside or (entrance is not null and m <= 100) or (barrier is not null and m <= 25)) union all select *, {_FAMILY} from {_POI}) where family is not null)"""


def _pois(spark, d) -> DataFrame:
    p = spatial.contained(B.customers(spark, d).selectExpr("id", "lat", "lng", *_POI_TAGS), B.RING)
    # unrounded: thresholds apply to the distance itself
    p = p.withColumn("m", geo.ring_distance(F.col("lat"), F.col("lng"), B.RING))
    c = F.col
    access = p.filter(records.is_access_point(c("entrance"), c("barrier"), c("inside"), c("m"))).withColumn("family", F.lit("access"))
    other = p.withColumn("family", records.family({k: c(k) for k in ("amenity", "drinking_water", "tourism", "public_transport")}, c("inside"), c("m"), c("known_view"), c("named"))).filter("family is not null")
    s = records.scope(c("inside"), c("m"), (c("family") == "viewpoint") & c("known_view"))
    return access.unionByName(other).select("id", "family", s.alias("s")).select("id", "family", "s.relation", F.col("s.boundary_distance_m").alias("boundary_m"))


@query(f"select id, family, relation, boundary_m, row_number() over (order by list_position(['access', 'toilet', 'drinking_water', 'viewpoint', 'shelter', 'transit', 'artwork'], family), id) - 1 nth from {_SELECTED}")
def visitor_features(spark, d):
    """Features by family from tags and distance to the boundary, in canonical order, with how they lie to the park."""
    order = F.array_position(F.array(*map(F.lit, records.FAMILIES)), F.col("family"))
    return sequences.numbered(_pois(spark, d).withColumn("o", order), ["o", "id"], "nth").drop("o")


@query(f"select id, string_agg(family, ' ' order by family) families from {_SELECTED} group by id having count(*) > 1")
def ambiguous_features(spark, d):
    """features that more than one family takes, which a build must refuse."""
    return _pois(spark, d).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("family")), " ").alias("families")).filter("n > 1").drop("n")


_SIGNATURE = ["way", "surface", "highway", "raw", "smoothness", "wheelchair", "access", "foot", "handrail", "direction", "incline", "route_incline", "sac"]
_SEGMENT = ["line", "pos", "d", "node % 3 way", "surface", "case when steps then 'steps' else 'path' end highway", "case node % 2 when 0 then 'gravel' end raw", "case line % 5 when 0 then 'bad' end smoothness", "case line % 7 when 0 then 'no' end wheelchair", "case line % 2 when 0 then 'yes' end access", "cast(null as varchar(9)) foot", "case line % 3 when 0 then 'left' end handrail", "case when node % 3 = 1 then 'reverse' else 'forward' end direction", "'up' incline", "case when node % 3 = 1 then 'down' else 'up' end route_incline", "case line % 11 when 0 then 'hiking' end sac"]


@query(f"""with v as (select {', '.join(_SEGMENT)} from {B.sql('polylines')}), f as (select *, case when pos = 1 or {' or '.join(f'lag({c}) over w is distinct from {c}' for c in _SIGNATURE)} then 1 else 0 end f from v window w as (partition by line order by pos)),
 r as (select *, sum(f) over (partition by line order by pos) run from f) select line, cast(run as bigint) run, {', '.join(_SIGNATURE)}, count(*) n, round(sum(d), 3) distance_m from r group by all""")
def surface_segments(spark, d):
    """Runs of equal signature along each line, all thirteen fields of it."""
    v = B.polylines(spark, d).selectExpr(*(c.replace("varchar(9)", "string") for c in _SEGMENT))
    return sequences.run_lengths(v, _SIGNATURE)


@query(f"with v as (select line, pos, node % 3 way from {B.sql('polylines')}), c as (select *, lag(way) over (partition by line order by pos) before from v) select line, string_agg(way, ' ' order by pos) ways from c where before is distinct from way group by line")
def way_sequences(spark, d):
    """The ways that each line takes, one after another without repeats in a row."""
    return sequences.without_repeats(B.polylines(spark, d).select("line", "pos", (F.col("node") % 3).alias("way")), "way").select("line", F.array_join(F.transform("ways", lambda x: x.cast("string")), " ").alias("ways"))


@query(f"""with recursive v as materialized (select line, pos, lat, lng, z from {B.sql('polylines')}), s as materialized (select a.line, a.pos, a.z, coalesce({Q.distance('b', 'a')}, 0) step from v a left join v b on a.line = b.line and b.pos = a.pos - 1),
 m as materialized (select line, max(pos) last from v group by line), r as (select line, pos, 0e0 acc, true kept from s where pos = 1 union all select s.line, s.pos, case when r.acc + s.step >= 900 then 0e0 else r.acc + s.step end, r.acc + s.step >= 900 from r join s on s.line = r.line and s.pos = r.pos + 1),
 k as (select r.line, r.pos, s.z from r join m on m.line = r.line join s on s.line = r.line and s.pos = r.pos where kept or r.pos = last), d as (select line, z, coalesce(z - lag(z) over (partition by line order by pos), 0) dz from k)
 select line, count(*) n_samples, round(sum(greatest(dz, 0)), 1) ascent_m, round(sum(greatest(-dz, 0)), 1) descent_m from d group by line""")
def sampled_climbs(spark, d):
    """Climbs over the vertices that a distance, starting anew at each, keeps."""
    return sequences.sampled_climbs(B.polylines(spark, d), 900.0)


_CONTENT = f"""(select coalesce(b.id, e.id) id, b.name de_name, e.name en_name from (select c_custkey id, nullif(case when c_custkey % 4 = 0 then '' else c_name end, '') name from customer where c_custkey % 3 <> 0) b
 full join (select c_custkey + 5 id, concat('en ', c_name) name from customer where c_custkey % 2 = 0) e on e.id = b.id)"""


@query(f"""select n.id, coalesce(de_name, en_name) name_de, coalesce(en_name, de_name) name_en, coalesce(de_name, en_name, concat('node ', n.id)) title, de_name is not null or en_name is not null enriched from (select c_custkey id from customer where c_custkey % 5 <> 0) n left join {_CONTENT} c on c.id = case when n.id = 7 then 8 else n.id end""")
def enriched_content(spark, d):
    """Nodes with their texts in two languages, each filling in for the other, found by an alias where one is set."""
    c = B.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    de = c.filter("id % 3 <> 0").select("id", F.nullif(F.when(F.col("id") % 4 == 0, "").otherwise(F.col("c_name")), F.lit("")).alias("de_name"))
    en = c.filter("id % 2 = 0").select((F.col("id") + 5).alias("id"), F.concat(F.lit("en "), "c_name").alias("en_name"))
    content = de.join(en, "id", "full").withColumnRenamed("id", "content")
    nodes = c.filter("id % 5 <> 0").select("id").withColumn("content", F.coalesce(F.try_element_at(F.create_map(F.lit(7), F.lit(8)), F.col("id").cast("int")).cast("long"), F.col("id")))
    j = nodes.join(content, "content", "left")
    name = lambda language, other: normalize.localized(F.col("de_name"), F.col("en_name"), language, other)
    return j.select("id", name("de", F.lit(None)).alias("name_de"), name("en", F.lit(None)).alias("name_en"), name("de", F.concat(F.lit("node "), F.col("id").cast("string"))).alias("title"), (F.col("de_name").isNotNull() | F.col("en_name").isNotNull()).alias("enriched"))


_TREE = ["p_partkey id", "case p_partkey % 10 when 0 then ' Insel ' when 1 then '' end explicit", "case p_partkey % 9 when 0 then 'an der Löwenburg' when 1 then 'Kaskaden' when 2 then 'am Lac' when 3 then 'beim Gewächshaus' when 4 then 'Mulang' when 5 then 'Waldschule' when 6 then 'ROSENINSEL' when 7 then 'Black Forest' end location", "case p_partkey % 3 when 0 then p_name end scientific", "case p_partkey % 4 when 0 then '' when 1 then p_type end german", "p_brand brand", "case p_partkey % 6 when 0 then p_type end significance"]


@query(f"""select id, case when trim(coalesce(explicit, '')) <> '' then trim(explicit) when regexp_matches(location, 'löwenburg|loewenburg|burgweg|burgwiese', 'i') then 'loewenburg' when regexp_matches(location, 'herkules|kaskad|fontän|fontaen|neptun|aquädukt|aquaedukt|wasserfall', 'i') then 'water-axis'
 when regexp_matches(location, 'schloss wilhelmshöhe|schloss wilhelmshoehe|bowlinggreen|\\blac\\b', 'i') then 'palace-lac' when regexp_matches(location, 'apolloberg|gewächshaus|gewaechshaus', 'i') then 'apolloberg' when regexp_matches(location, 'mulang|chines', 'i') then 'mulang'
 when regexp_matches(location, 'tulpenallee|gärtnerei|gaertnerei|waldschule|nordost|nordöst', 'i') then 'north-east' when regexp_matches(location, 'roseninsel', 'i') then 'roseninsel' else 'other-park' end sector,
 coalesce(nullif(german, ''), nullif(scientific, ''), '—') species, coalesce(significance, 'catalogued') significance, concat('tree-', id) tree_id, case when id % 2 = 0 then replace(brand, 'Brand#', 'b') end ref from (select {', '.join(_TREE)} from part)""")
def tree_records(spark, d):
    """Trees with their part of the park, species and significance from what is stated or can be read from the place."""
    t = B.table(spark, d, "part").selectExpr(*_TREE)
    c = F.col
    return t.select("id", records.sector(c("explicit"), c("location")).alias("sector"), F.coalesce(records.first_text(c("german"), c("scientific")), F.lit("—")).alias("species"), F.coalesce("significance", F.lit("catalogued")).alias("significance"), F.concat(F.lit("tree-"), c("id").cast("string")).alias("tree_id"), F.when(c("id") % 2 == 0, F.replace(c("brand"), F.lit("Brand#"), F.lit("b"))).alias("ref"))


_URLS = ["p_partkey id", "case p_partkey % 4 when 0 then concat('http://x.org/', p_partkey) when 1 then 'ftp://x.org' when 2 then 'javascript:1' end u0", "case p_partkey % 3 when 0 then 'HTTPS://y.org/a' when 1 then 'https://' end u1", "case p_partkey % 5 when 0 then concat('https://z.org/?q=', p_size) end u2"]


@query(f"select id, coalesce(case when regexp_matches(u0, '^https?://[^ /]+', 'i') then u0 end, case when regexp_matches(u1, '^https?://[^ /]+', 'i') then u1 end, case when regexp_matches(u2, '^https?://[^ /]+', 'i') then u2 end) url from (select {', '.join(_URLS)} from part)")
def source_urls(spark, d):
    """the first address that a browser may follow."""
    return B.table(spark, d, "part").selectExpr(*_URLS).select("id", normalize.first_absolute_url(F.array("u0", "u1", "u2")).alias("url"))


_VALUES = ["p_partkey id", "case p_size % 4 when 0 then cast('nan' as double) when 1 then cast('inf' as double) when 2 then p_size / 10e0 end x", "case p_partkey % 3 when 0 then 'glow' when 1 then 'relief' end kind", "p_partkey * 7.5e0 - 700 lng"]


@query(f"select id, case when isfinite(x) then x end x, case when kind = 'glow' then 'glow' else 'plain' end kind, least(greatest(coalesce(case when isfinite(x) then x end, 1), 0.7), 1.6)::double scale, round(((lng + 180) - 360 * floor((lng + 180) / 360)) - 180, 6) turned, ((lng + 180) - 360 * floor((lng + 180) / 360)) - 180 between 170 and 180 or ((lng + 180) - 360 * floor((lng + 180) / 360)) - 180 between -180 and -160 pacific from (select {', '.join(_VALUES)} from part)")
def guarded_values(spark, d):
    """Numbers that are none become null, scales are held in bounds, longitudes turned, also across the antimeridian."""
    v = B.table(spark, d, "part").selectExpr(*_VALUES)
    p = records.presentation(F.col("x"), F.col("kind"), "plain", ("plain", "glow"))
    return v.select("id", geo.finite(F.col("x")).alias("x"), p["kind"].alias("kind"), p["scale"].alias("scale"), F.round(geo.longitude(F.col("lng")), 6).alias("turned"), geo.longitude_between(F.col("lng"), F.lit(170.0), F.lit(200.0)).alias("pacific"))


@query(f"""with v as (select line, pos, case node % 6 when 0 then 'yes' when 1 then 'no' end wheelchair, case node % 5 when 0 then 'left' when 1 then 'both' end handrail, steps, d from {B.sql('polylines')}),
 w as (select line, count(*) n, string_agg(wheelchair, ', ' order by first) v from (select line, wheelchair, min(pos) first, count(*) c from v where wheelchair is not null group by all) group by line), wc as (select line, count(wheelchair) n from v group by line),
 h as (select line, string_agg(handrail, ', ' order by first) v from (select line, handrail, min(pos) first from v where handrail is not null group by all) group by line), hc as (select line, count(handrail) n, sum(case when steps then d else 0 end) step_m, bool_or(steps) has_steps from v group by line)
 select line, case when wc.n = 0 then 'No explicit wheelchair tags on the mapped segments.' else concat('OSM wheelchair evidence on ', wc.n, ' segment(s): ', w.v, '.') end wheelchair, case when hc.n = 0 then 'No explicit handrail tags on the mapped segments.' else concat('OSM handrail evidence on ', hc.n, ' segment(s): ', h.v, '.') end handrail,
 case when step_m > 0 then concat('OSM route contains about ', cast(round_even(step_m, 0) as bigint), ' m of steps; not step-free.') else 'OSM walking route with segment-level surfaces and GLO-90 elevation profile; accessibility not field-verified.' end note, case when has_steps then 'Mapped steps' else 'Accessibility not fully evidenced' end access
 from wc join hc using (line) left join w using (line) left join h using (line)""")
def evidence_texts(spark, d):
    """What a route's segments say of wheelchairs and handrails, and what a walker is told."""
    v = B.polylines(spark, d).selectExpr("line", "pos", "case node % 6 when 0 then 'yes' when 1 then 'no' end wheelchair", "case node % 5 when 0 then 'left' when 1 then 'both' end handrail", "steps", "d")
    # the vertices of one order
    g = v.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("pos", "wheelchair", "handrail"))).alias("s"), F.coalesce(F.sum(F.when(F.col("steps"), F.col("d"))), F.lit(0.0)).alias("step_m"), F.bool_or("steps").alias("has_steps"))
    g = g.withColumn("w", records.tag_evidence(F.col("s"), "wheelchair")).withColumn("h", records.tag_evidence(F.col("s"), "handrail"))
    return g.select("line", records.evidence_text(F.col("w.n"), F.col("w.values"), "wheelchair").alias("wheelchair"), records.evidence_text(F.col("h.n"), F.col("h.values"), "handrail").alias("handrail"), records.route_note(F.col("step_m")).alias("note"), records.access_summary(F.col("has_steps"), F.lit(None)).alias("access"))
