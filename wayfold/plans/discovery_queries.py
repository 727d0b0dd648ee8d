"""Discovery: filters, rankings and indexes over places, trees, features and the walking network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo, normalize, records
from wayfold.operators import graph, search, sequences
from wayfold.plans import bindings as B
from wayfold.plans import sqltext as Q
from wayfold.plans.registry import query
from wayfold.streaming import history

_KIND = "case w % 4 when 0 then 'created' when 1 then 'member_of_collection' when 2 then 'located_at' else 'near_by' end"
_OPTION = ["id", "src", "dst", "case when w % 9 <> 0 then cast(greatest(1, floor(w / 80e0)) as int) end walk_min", "case when w % 8 <> 0 then w * 1e0 end distance", "case when w % 7 <> 0 then p_size % 9 * 1e0 end ascent", "case when w % 7 <> 0 then p_size % 5 * 1e0 end descent", "case when w % 6 <> 0 then p_size % 9 - p_size % 5 - 0e0 end delta"]
_TARGET = ["node", "node % 7 = 0 viewpoint", "case node % 5 when 0 then 'castle' when 1 then 'no' when 2 then '' end historic"]
_WATER = "case w % 10 when 0 then 'lies on the water axis' when 1 then 'Achse der Wasserkünste' when 2 then 'axis' else 'near' end"
_ON_AXIS = f"(select distinct unnest([src, dst]) node from (select *, {_WATER} said from {B.EDGES}) where regexp_matches(said, '(water|Wasser).*(axis|achse)|(axis|achse).*(water|Wasser)', 'i'))"


def _options(spark, d) -> tuple[DataFrame, DataFrame]:
    edges = B._edges_with_size(spark, d)
    said = F.expr(_WATER)
    axis = edges.filter(said.rlike("(?iu)(water|Wasser).*(axis|achse)|(axis|achse).*(water|Wasser)")).select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    targets = B.shape(spark, d, "nodes").filter("node % 31 <> 3").selectExpr(*_TARGET).join(axis.withColumn("water_axis", F.lit(True)), "node", "left")
    targets = targets.select("node", "viewpoint", records.has_heritage(F.col("historic")).alias("heritage"), F.coalesce("water_axis", F.lit(False)).alias("water_axis"))
    return edges.selectExpr(*_OPTION).withColumnRenamed("walk_min", "minutes"), targets


def _options_sql(sort: str, only: str | None, limit: int) -> str:
    keep = f"where list_contains(affordances, '{only}')" if only else ""
    return f"""(select * from (select src, id, dst, affordances, cast(row_number() over (partition by src order by {sort} nulls last, walk_min nulls last, distance nulls last, id) as int) place from (
 select o.*, list_filter(['nearby', case when delta > 2 then 'uphill' when delta < -2 then 'downhill' end, case when viewpoint then 'viewpoint' end, case when dst in (select node from {_ON_AXIS}) then 'water-axis' end, case when historic <> '' and historic <> 'no' then 'heritage' end], lambda x: x is not null) affordances
 from (select {', '.join(_OPTION)} from {B.EDGES}) o join (select {', '.join(_TARGET)} from {B.sql('nodes')} where node % 31 <> 3) t on t.node = o.dst) {keep}) where place <= {limit})"""


@query(f"select src, id, dst, array_to_string(affordances, ' ') affordances, place from {_options_sql('ascent', None, 8)}")
def route_options(spark, d):
    """Each node's direct routes with what they afford, by ascent and a chain of further metrics, unknown ones last, eight at most."""
    return search.route_options(*_options(spark, d), sort="ascent").withColumn("affordances", F.array_join("affordances", " "))


@query(f"select src, id, dst, place from {_options_sql('walk_min', 'heritage', 8)}")
def heritage_routes(spark, d):
    """direct routes to heritage, by time; a sort that isn't known counts as time."""
    return search.route_options(*_options(spark, d), sort="beauty", only="heritage").drop("affordances")


_STATUS = "case when steps then 'known_steps' when barrier = 'stile' then 'known_barrier_mobility_constraint' else 'unknown_not_field_verified' end"
_INDEX = f"""(select concat('node-', node) id, 'junction' kind, 'Path junction' title, concat(n, ' connections') context, 'junction kreuzung' keywords from (select node, count(distinct other) n from (select src node, dst other from {B.SEGMENTS} union all select dst, src from {B.SEGMENTS}) group by 1) where n >= 3
 union all select id, case when coalesce(steps, false) then 'steps' else 'path' end, case when coalesce(steps, false) then 'Mapped steps' else 'Mapped path segment' end, concat_ws(' · ', 'path', surface, concat(cast(floor(distance_m + 0.5) as bigint), ' m')), concat_ws(' ', src, dst, surface, {_STATUS}) from {B.SEGMENTS} where not back)"""


@query(f"with h as (select * from {_INDEX} where contains(lower(concat_ws(' ', id, title, context, keywords)), '7')) select id, kind, title, context, (select count(*) from h) total from h order by case kind when 'junction' then 0 when 'steps' then 1 else 2 end, id limit 40")
def network_search(spark, d):
    """The first forty junctions, steps and paths of the network that hold a text, and how many there are."""
    s = B.segments(spark, d)
    nodes = graph.degrees(s.select("src", "dst"))
    status = normalize.segment_access(F.lit(False), F.col("steps"), F.lit(None), F.array(F.when(F.col("barrier") == "stile", "stile")))
    segments = s.filter("not back").withColumn("accessibility_status", status).withColumn("highway", F.lit(None).cast("string"))
    return search.search_network(search.network_index(nodes, segments), " 7 ").select("id", "kind", "title", "context", "total")


@query("""select p_partkey id from part where (contains(lower(concat_ws(' ', nullif(p_type, ''), p_name, p_partkey, p_brand)), 'ring') or contains(lower(concat_ws(' ', nullif(p_type, ''), p_name, p_partkey, p_brand)), 'red')) and p_size % 3 = 1 and p_brand <> 'x'""")
def filtered_parts(spark, d):
    """parts by several facets at once, 'all' leaving a facet open, and a text found anywhere in what describes them."""
    part = B.table(spark, d, "part").withColumn("third", (F.col("p_size") % 3).cast("string"))
    hay = ["p_type", "p_name", "p_partkey", "p_brand"]
    found = sequences.facet_filter(part, hay, "ring", {"third": "1", "p_brand": "all"}).unionByName(sequences.facet_filter(part, hay, " RED ", {"third": "1", "p_type": "all"}))
    return found.select(F.col("p_partkey").alias("id")).distinct()


_ENTRIES = f"""(select 'entity' kind, concat('e', id) id, 0 source, lat, lng, 'place' category, id nth from {B.sql('places')} union all select 'tree', concat('t', node % 150), 3, lat, lng, 'tree', 1000 + node from {B.sql('nodes')}
 union all select 'feature', concat('f', id), 4, lat, lng, 'feature', 10000000 + id from {B.sql('customers')} where id % 2 = 0 union all select 'network', id, 5, null, null, 'walk', 20000000 + src * 10 + (dst % 10) from {B.SEGMENTS} where not back union all select 'entity', concat('s', id), 1, lat, lng, 'story', 5000 + id from {B.sql('suppliers')})"""


def _almanac(spark, d) -> DataFrame:
    e = lambda df, kind, ident, source, category, nth, lat="lat", lng="lng": df.select(F.lit(kind).alias("kind"), ident.alias("id"), F.lit(source).alias("source"), F.col(lat).cast("double").alias("lat") if lat else F.lit(None).cast("double").alias("lat"), F.col(lng).cast("double").alias("lng") if lng else F.lit(None).cast("double").alias("lng"), F.lit(category).alias("category"), nth.cast("long").alias("nth"))
    c = F.col
    places, nodes, customers, suppliers = B.places(spark, d), B.shape(spark, d, "nodes"), B.customers(spark, d), B.suppliers(spark, d)
    rows = [
        e(places, "entity", F.concat(F.lit("e"), c("id")), 0, "place", c("id")),
        e(nodes, "tree", F.concat(F.lit("t"), c("node") % 150), 3, "tree", 1000 + c("node")),
        e(customers.filter("id % 2 = 0"), "feature", F.concat(F.lit("f"), c("id")), 4, "feature", 10000000 + c("id")),
        e(B.segments(spark, d).filter("not back"), "network", c("id"), 5, "walk", 20000000 + c("src") * 10 + c("dst") % 10, None, None),
        e(suppliers, "entity", F.concat(F.lit("s"), c("id")), 1, "story", 5000 + c("id")),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return search.last_by_key(out, ["kind", "id"], "nth")


_KEPT = f"(select kind, id, arg_max(lat, nth) lat, arg_max(lng, nth) lng, arg_max(category, nth) category, min(nth) nth from {_ENTRIES} group by kind, id)"


@query(f"select c category, coalesce(n, 0) n, located from (values ('place'), ('story'), ('tree'), ('feature'), ('walk'), ('tour')) v(c) left join (select category, count(*) n, count(lat) located from {_KEPT} group by 1) on category = c")
def almanac_counts(spark, d):
    """Places, stories, trees, features and walks in one index, an entry that comes again keeping its place; counts by category, zero where none is."""
    domain = spark.createDataFrame([(x,) for x in ("place", "story", "tree", "feature", "walk", "tour")], "category string")
    counts = _almanac(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count("lat").alias("located"))
    return domain.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"), "located")


_NEAR = Q.distance("o", "e")


@query(f"""with e as (select * from {_KEPT} where category in ('place', 'tree', 'feature')), o as (select concat('e', id) id, lat, lng from {B.sql('places')}), p as (select o.id, e.id other, round({_NEAR}, 3) distance_m from o, e where o.id <> e.id),
 r as (select *, row_number() over (partition by id order by distance_m, other) rank from p where distance_m <= 250) select id, other, distance_m, cast(rank as int) rank from r where rank <= 6""")
def nearby_entries(spark, d):
    """Around each place the nearest six entries of three categories within 250 m, itself left out."""
    origins = B.places(spark, d).withColumn("id", F.concat(F.lit("e"), "id"))
    return search.nearby(origins, _almanac(spark, d).filter("lat is not null")).select("id", "other", "distance_m", "rank")


_RANKS = {"created": 0, "member_of_collection": 3, "located_at": 4}
_RANK_SQL = "case kind " + " ".join(f"when '{k}' then {v}" for k, v in _RANKS.items()) + " else 99 end"


@query(f"""with e as (select id, src, dst, {_KIND} kind from {B.EDGES}), i as (select src entity, dst other, kind, id key from e union all select dst, src, kind, id from e), a as (select entity, other, kind, {_RANK_SQL} r, 0 source, 0 nth, key from i where entity <> other
 union all select src, dst, 'nearby', 100, 1, place, id from {_options_sql('walk_min', None, 8)} where src <> dst), f as (select *, row_number() over (partition by entity, other order by source, nth, key) n from a),
 p as (select *, row_number() over (partition by entity order by r, nth, key, other) place from f where n = 1) select entity, other, kind, case kind when 'created' then 'created' when 'member_of_collection' then 'belongs to the collection' when 'located_at' then 'is located at' when 'near_by' then 'near by' else 'nearby' end label, cast(place as int) place from p where place <= 8""")
def related_journeys(spark, d):
    """Eight stops around each entity, by relations and direct walks, each once, with the relation in words."""
    relations = B.graph_edges(spark, d).selectExpr("id", "src", "dst", f"{_KIND} kind")
    out = search.related(relations, _RANKS, search.route_options(*_options(spark, d)))
    return out.select("entity", "other", "kind", records.relation_label(F.col("kind")).alias("label"), "place")


_TIER = lambda f, base: f"case when lower(strip_accents({f})) = '' then null when lower(strip_accents({f})) = 'red' then {base} when starts_with(lower(strip_accents({f})), 'red') then {base + 1} when contains(lower(strip_accents({f})), 'red') then {base + 2} end"
_NAMED = ["p_partkey id", "case p_partkey % 4 when 0 then replace(p_name, 'red', 'réd') when 1 then '' else p_name end title", "p_type kind", "replace(p_brand, 'Brand', 'Red') brand", "case p_partkey % 3 when 0 then 'RED' end word", "concat('all about ', p_name) about"]


@query(f"""with n as (select {', '.join(_NAMED)} from part), s as (select id, list_filter([{{'s': {_TIER('title', 0)}, 'n': 0, 'l': null::varchar}}, {{'s': {_TIER('kind', 3)}, 'n': 1, 'l': 'kind'}}, {{'s': {_TIER('brand', 3)}, 'n': 2, 'l': 'brand'}}, {{'s': {_TIER('word', 7)}, 'n': 3, 'l': null}}, {{'s': {_TIER('about', 20)}, 'n': 4, 'l': null}}], lambda x: x.s is not null) t from n)
 select id, cast(list_min(t).s as int) score, list_min(t).l as label from s where len(t) > 0""")
def search_labels(spark, d):
    """The best field of each part for a word, accents apart, over title, facets, keywords and text, with the facet that won."""
    n = B.table(spark, d, "part").selectExpr(*_NAMED)
    c = F.col
    hit = search.best_match("Réd", c("title"), [(c("kind"), "kind"), (c("brand"), "brand")], [c("word")], [c("about")])
    return n.select("id", hit.alias("m")).filter("m is not null").select("id", F.col("m.score").cast("int").alias("score"), "m.label")


@query("select p_partkey id, 50 score from part")
def search_everything(spark, d):
    """Without a word everything is found, with one score."""
    return B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), search.score("  ", F.col("p_name"), [], [], []).alias("score"))


@query(f"with s as (select line, coalesce(surface, 'unknown') s, sum(d) m from {B.sql('polylines')} group by all) select line, string_agg(s, ' ' order by m desc, s) surfaces from s group by line")
def surface_order(spark, d):
    """Each line's surfaces, the longest first."""
    s = B.polylines(spark, d).groupBy("line", F.coalesce("surface", F.lit("unknown")).alias("s")).agg(F.sum("d").alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("m"), "s")))
    return s.groupBy("line").agg(F.array_join(F.transform(ordered, lambda x: x["s"]), " ").alias("surfaces"))


@query("select p_partkey id, p_size priority from part where p_type in (select p_type from part group by p_type order by p_type limit 3) order by p_size desc, p_partkey limit 30")
def descriptor_family(spark, d):
    """The entities that a fixed policy names, by priority, then id."""
    part = B.table(spark, d, "part")
    policy = part.select("p_type").distinct().orderBy("p_type").limit(3)
    return part.join(policy, "p_type", "left_semi").orderBy(F.desc("p_size"), "p_partkey").limit(30).select(F.col("p_partkey").alias("id"), F.col("p_size").alias("priority"))


_BOX = (51.311, 9.395, 51.317, 9.41)


@query(f"select id from {B.sql('customers')} where lat between {_BOX[0]}e0 - 0.006e0 * 0.15e0 and {_BOX[2]}e0 + 0.006e0 * 0.15e0 and lng between {_BOX[1]}e0 - 0.015e0 * 0.15e0 and {_BOX[3]}e0 + 0.015e0 * 0.15e0 and id % 4 in (1, 2)")
def viewport_points(spark, d):
    """points of the shown kinds within the view and a margin of 15 percent around it."""
    return B.customers(spark, d).filter(geo.in_box(F.col("lat"), F.col("lng"), _BOX, pad=0.15) & (F.col("id") % 4).isin(1, 2)).select("id")


@query(f"select lat7, lng7, min(nth) nth from (select {', '.join(f'cast(round(round({c}, 3) * 1e7) as bigint) {c}7' for c in ('lat', 'lng'))}, nth from (select lat, lng, id nth from {B.sql('suppliers')} union all select lat, lng, 10000000 + node from {B.sql('nodes')})) group by all")
def coordinate_union(spark, d):
    """Coordinates of several layers, each once, where it was first seen."""
    rows = B.suppliers(spark, d).select("lat", "lng", F.col("id").alias("nth")).unionByName(B.shape(spark, d, "nodes").select("lat", "lng", (F.col("node") + 10000000).alias("nth")))
    lat, lng = geo.coordinate_key(F.round("lat", 3), F.round("lng", 3))
    return rows.groupBy(lat.alias("lat7"), lng.alias("lng7")).agg(F.min("nth").alias("nth"))


@query(f"""with s as (select *, row_number() over (partition by least(src, dst), greatest(src, dst) order by id) n from {B.SEGMENTS} where distance_m >= 100)
 select id, src, dst, distance_m, case when steps then 'yes' when not steps then 'no' else 'unknown' end steps, case when w = 0 then 'unknown' when steps is null then 'unknown' else 'known' end evidence from (select *, 1 w from s) where n = 1""")
def published_network(spark, d):
    """What is published of the network: segments long enough, one for each pair of nodes, with steps known, denied or unknown."""
    s = graph.first_by_pair(B.segments(spark, d).filter("distance_m >= 100"), "id")
    steps = F.when(F.col("steps"), "yes").when(~F.col("steps"), "no").otherwise("unknown")
    return s.select("id", "src", "dst", "distance_m", steps.alias("steps"), F.when(F.col("steps").isNull(), "unknown").otherwise("known").alias("evidence"))


_EVIDENCE = f"""(select e.id, case when s.id is not null then 'dgm1' when e.w % 3 = 0 then 'legacy' else 'unknown' end status, case when s.id is not null then s.ascent when e.w % 3 = 0 then e.w % 11 * 1e0 end ascent, case when s.id is not null then s.descent when e.w % 3 = 0 then e.w % 6 * 1e0 end descent,
 case when s.id is not null then s.low end low, case when s.id is not null then s.high end high, case when s.id is not null then s.grade when e.w % 3 = 0 then (e.w % 7 - 3) / 4e0 end grade from {B.EDGES} e left join (select id, w % 10 * 1e0 ascent, w % 4 * 1e0 descent, 200 + w % 50 * 1e0 low, 260 + w % 50 * 1e0 high, (w % 9 - 4) / 8e0 grade from {B.EDGES} where w % 2 = 0) s on s.id = e.id)"""


@query(f"""select id, status, ascent, descent, concat_ws(' · ', case when ascent - descent > 2 then 'uphill' when ascent - descent < -2 then 'downhill' when ascent is null or descent is null then 'direction unknown' else 'nearly level' end, concat('↑ ', cast(floor(ascent + 0.5) as bigint)::varchar || ' m'), concat('↓ ', cast(floor(descent + 0.5) as bigint)::varchar || ' m'),
 cast(floor(low + 0.5) as bigint)::varchar || '–' || cast(floor(high + 0.5) as bigint)::varchar || ' m', 'net ' || case when grade > 0 then '+' else '' end || printf('%.1f', round(grade, 1)) || '%', case status when 'dgm1' then 'DGM1' when 'legacy' then 'GLO-90 fallback' else 'elevation unknown' end) summary from {_EVIDENCE}""".replace("concat('↑ ', ", "('↑ ' || ").replace("concat('↓ ', ", "('↓ ' || "))
def route_evidence(spark, d):
    """Each route's terrain by the better source that has it, unknown where neither does, and in words."""
    e = B.graph_edges(spark, d)
    fine = e.filter("w % 2 = 0").selectExpr("id", "w % 10 * 1e0 f_ascent", "w % 4 * 1e0 f_descent", "200 + w % 50 * 1e0 f_low", "260 + w % 50 * 1e0 f_high", "(w % 9 - 4) / 8e0 f_grade", "true fine")
    coarse = e.filter("w % 3 = 0").selectExpr("id", "w % 11 * 1e0 c_ascent", "w % 6 * 1e0 c_descent", "(w % 7 - 3) / 4e0 c_grade", "true coarse")
    j = e.join(fine, "id", "left").join(coarse, "id", "left")
    status = F.when(F.col("fine"), "dgm1").when(F.col("coarse"), "legacy").otherwise("unknown")
    pick = lambda c: F.when(F.col("fine"), F.col(f"f_{c}")).otherwise(F.col(f"c_{c}"))
    j = j.select("id", status.alias("status"), *(pick(c).alias(c) for c in ("ascent", "descent", "grade")), F.col("f_low").alias("low"), F.col("f_high").alias("high"))
    direction = normalize.terrain_direction(F.col("ascent") - F.col("descent"))
    return j.select("id", "status", "ascent", "descent", records.terrain_summary(direction, *(F.col(c) for c in ("ascent", "descent", "low", "high", "grade", "status"))).alias("summary"))


_STEP = ["user_id", "event_id", "ts", "case when event_id % 10 = 0 then 'reset' when event_id % 4 = 0 then 'back' else 'visit' end op", "concat('x', cast(floor(value) as bigint) % 5) target"]


@query(f"""with recursive e as materialized (select {', '.join(_STEP)}, row_number() over (partition by user_id order by ts, event_id) pos from events),
 r(user_id, pos, current, history) as (select user_id, 0::bigint, null::varchar, []::varchar[] from (select distinct user_id from e) union all select e.user_id, e.pos, case op when 'visit' then target when 'reset' then target else case when len(history) > 0 then history[len(history)] else current end end,
  case op when 'reset' then [] when 'back' then case when len(history) > 0 then history[:len(history) - 1] else history end else case when current is not null and current <> target then case when len(history) >= 12 then list_append(history[2:], current) else list_append(history, current) end else history end end from r join e on e.user_id = r.user_id and e.pos = r.pos + 1)
 select user_id, arg_max(current, pos) current, array_to_string(arg_max(history, pos), ' ') history from r where pos > 0 group by user_id""")
def visited_trails(spark, d):
    """Where each user is and how they came there: visits, steps back and resets, twelve places of history at most."""
    out = history.trails(B.table(spark, d, "events").selectExpr(*_STEP))
    return out.select("user_id", "current", F.array_join("history", " ").alias("history"))



@query("""select concat('f', c_custkey) id, coalesce(nullif(case when c_custkey % 3 = 0 then c_mktsegment end, ''), 'historical_figure') as type, concat_ws(' ', case when c_custkey % 2 = 0 then 'painter' end, case when c_custkey % 5 = 0 then c_mktsegment end, case when c_custkey % 7 = 0 then concat('place-', c_nationkey) end) terms,
 coalesce((select string_agg(concat(s, ':', coalesce(n_name, '?')), ' ' order by s) from (values (c_custkey % 30), (c_custkey % 4 + 100)) v(s) left join nation on n_nationkey = s), '') sources from customer""")
def semantic_entities(spark, d):
    """Entities with a type by default, the terms that find them, and their sources looked up, those that aren't known by their id alone."""
    c = B.table(spark, d, "customer")
    ids = F.explode(F.array((F.col("c_custkey") % 30).cast("long"), (F.col("c_custkey") % 4 + 100).cast("long")))
    named = c.select("c_custkey", ids.alias("s")).join(B.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("s"), "n_name"), "s", "left")
    sources = named.groupBy("c_custkey").agg(F.array_sort(F.collect_list(F.struct("s", F.concat(F.col("s").cast("string"), F.lit(":"), F.coalesce("n_name", F.lit("?"))).alias("t")))).alias("x"))
    kind = records.first_text(F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")), F.lit("historical_figure"))
    terms = F.concat_ws(" ", F.when(F.col("c_custkey") % 2 == 0, "painter"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_mktsegment")), F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("place-"), F.col("c_nationkey").cast("string"))))
    return c.join(sources, "c_custkey").select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("id"), kind.alias("type"), terms.alias("terms"), F.array_join(F.transform("x", lambda r: r["t"]), " ").alias("sources"))


@query(f"""with s as (select line, coalesce(surface, 'unknown') s, sum(d) m from {B.sql('polylines')} group by all), g as (select line, string_agg(concat(s, ' ', cast(floor(m + 0.5) as bigint), ' m'), ' · ' order by m desc, s) surfaces from s group by line),
 t as (select line, count_if(steps) n, coalesce(sum(case when steps then d end), 0) m from {B.sql('polylines')} group by line)
 select line, surfaces, case when n > 0 then concat(n, ' mapped step segment(s), ', cast(floor(m + 0.5) as bigint), ' m') else 'No mapped steps on this route' end steps from g join t using (line)""")
def walk_explanations(spark, d):
    """A walk in words: its surfaces, the longest first, and its steps."""
    v = B.polylines(spark, d)
    s = v.groupBy("line", F.coalesce("surface", F.lit("unknown")).alias("s")).agg(F.sum("d").alias("m"))
    text = F.concat(F.col("s"), F.lit(" "), records.whole(F.col("m")), F.lit(" m"))
    surfaces = s.groupBy("line").agg(F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("m"), "s", text.alias("t")))).alias("x"))
    steps = v.groupBy("line").agg(F.count_if("steps").alias("n"), F.coalesce(F.sum(F.when(F.col("steps"), F.col("d"))), F.lit(0.0)).alias("m"))
    words = F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" mapped step segment(s), "), records.whole(F.col("m")), F.lit(" m"))).otherwise("No mapped steps on this route")
    return surfaces.join(steps, "line").select("line", F.array_join(F.transform("x", lambda r: r["t"]), " · ").alias("surfaces"), words.alias("steps"))
