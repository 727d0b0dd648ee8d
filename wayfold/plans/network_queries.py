"""Routes, pairs of places, and the topology that they run on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import normalize
from wayfold.operators import contracts, graph, routing, spatial, topology
from wayfold.plans import bindings as B
from wayfold.plans import sqltext as Q
from wayfold.plans.registry import query

_N = "(select count(*) from part)"
_STATUS = "case when steps then 'known_steps' when wheelchair = 'no' then 'known_wheelchair_no' when barrier in ('stile', 'turnstile') then 'known_barrier_mobility_constraint' else 'unknown_not_field_verified' end"
_PATHS = f"(select *, {_STATUS} accessibility_status from {B.SEGMENTS})"
_CLOSED = lambda foot, access: f"coalesce({foot} = 'no', false) or (coalesce({access} in ('private', 'no'), false) and not coalesce({foot} in ('yes', 'designated', 'permissive'), false))"
_ALLOWED = f"(select * from {_PATHS} where eligible and not ({_CLOSED('foot', 'access')}) and not ({_CLOSED('gate_foot', 'gate_access')}))"


def _segments(spark, d) -> DataFrame:
    s = B.segments(spark, d)
    gate = F.array(F.struct(F.col("gate_foot").alias("foot"), F.col("gate_access").alias("access"), "barrier"))
    status = normalize.segment_access(F.lit(False), F.col("steps"), F.col("wheelchair"), F.array("barrier"))
    return s.withColumn("barriers", gate).withColumn("accessibility_status", status)


def _names(spark, d) -> DataFrame:
    nodes, n = B.graph_nodes(spark, d), B.n_nodes(spark, d)
    own = nodes.select(F.col("node").cast("string").alias("name"), "node", F.lit(0).alias("rank"))
    place = B.places(spark, d).select(F.concat(F.lit("place-"), "id").alias("name"), ((F.col("id") * 37) % n).alias("node"), F.lit(1).alias("rank"))
    return own.unionByName(place).unionByName(nodes.select(F.concat(F.lit("osm-"), F.col("node") + 1000000).alias("name"), "node", F.lit(2).alias("rank")))


_ASKED = "select id request, case id % 4 when 0 then cast(id * 7 as {text}) when 1 then concat('place-', id) when 2 then concat('osm-', 1000000 + id * 5) else concat('place-', (id * 3) % 25) end from_name, case when id % 11 = 3 then 'nowhere' when id = 8 then cast(56 as {text}) else concat('place-', (id + 1) % 25) end to_name"


def _requests(spark, d) -> DataFrame:
    asked = B.places(spark, d).selectExpr(*_ASKED.removeprefix("select ").format(text="string").replace(" request,", " request|").replace(" from_name,", " from_name|").split("|"))
    names = _names(spark, d)
    both = routing.resolve(routing.resolve(asked, names, "from_name"), names, "to_name")
    return both.select("request", F.col("from_name_node").alias("from_node"), F.col("to_name_node").alias("to_node"))


_ROUTES = f"""with recursive p as (select id, (id * 37) % {_N} node from {B.sql('places')}), asked as ({_ASKED.format(text='varchar')} from {B.sql('places')}),
 names as (select cast(p_partkey as varchar) name, p_partkey node, 0 rank from part union all select concat('place-', id), node, 1 from p union all select concat('osm-', p_partkey + 1000000), p_partkey, 2 from part),
 best as (select name, arg_min(node, (rank, node)) node from names group by name),
 q as materialized (select request, a.node from_node, b.node to_node from asked left join best a on a.name = from_name left join best b on b.name = to_name),
 s as materialized (select id, src, dst, [case when steps then distance_m else 0 end, coalesce(ascent_m, distance_m * 0.1::double), distance_m] w from {_ALLOWED}),
 r(origin, node, label) using key (origin, node) as (select distinct from_node, from_node, {{'c': [0e0, 0e0, 0e0], 'p': []::varchar[]}} from q where from_node is not null and to_node is not null union
  select r.origin, s.dst, min({{'c': [r.label.c[1] + s.w[1], r.label.c[2] + s.w[2], r.label.c[3] + s.w[3]], 'p': list_append(r.label.p, s.id)}}) from r join s on s.src = r.node
  left join recurring.r k on k.origin = r.origin and k.node = s.dst where k.label is null or {{'c': [r.label.c[1] + s.w[1], r.label.c[2] + s.w[2], r.label.c[3] + s.w[3]], 'p': list_append(r.label.p, s.id)}} < k.label group by r.origin, s.dst),
 f as materialized (select request, from_node, to_node, case when from_node is null or to_node is null then 'unknown-endpoint' when r.label is null then 'no-route' else 'ok' end outcome, r.label.c cost, r.label.p path from q left join r on r.origin = q.from_node and r.node = q.to_node)"""


@query(_ROUTES + " select request, from_node, to_node, outcome, round(cost[1], 6) step_m, round(cost[2], 6) ascent_score, round(cost[3], 6) distance_m, array_to_string(path, ' ') segments from f")
def lexicographic_routes(spark, d):
    """Routes by (known steps, ascent score, distance), ties by segment ids, over admissible segments; endpoints by any of their names."""
    found = routing.routes(_segments(spark, d), _requests(spark, d), "avoid_known_steps_lower_ascent")
    cost = lambda i: F.round(F.get("cost", F.lit(i)), 6)
    return found.select("request", "from_node", "to_node", "outcome", cost(0).alias("step_m"), cost(1).alias("ascent_score"), cost(2).alias("distance_m"), F.array_join("path", " ").alias("segments"))


@query(_ROUTES + f""", l as (select request, unnest(case when len(path) > 0 then path else [null] end) id from f where outcome = 'ok'), j as (select request, s.* from l left join {_PATHS} s using (id)),
 g as (select request, count(id) n_segments, round(coalesce(sum(distance_m), 0), 2) distance_m, round(coalesce(sum(ascent_m), 0), 1) known_ascent_m, round(coalesce(sum(descent_m), 0), 1) known_descent_m, round(coalesce(sum(case when ascent_m is null then distance_m end), 0), 2) terrain_unknown_m,
 round(coalesce(sum(case when steps then distance_m end), 0), 2) known_step_m, round(coalesce(sum(case when accessibility_status in ('unknown_not_field_verified', 'unknown_unmapped_connector') then distance_m end), 0), 2) unknown_access_m,
 coalesce(string_agg(distinct accessibility_status, ' ' order by accessibility_status) filter (starts_with(accessibility_status, 'known_')), '') negative_evidence from j group by request)
 select *, case when negative_evidence <> '' then 'known_negative_accessibility_evidence' else 'unknown_not_an_accessibility_claim' end accessibility_status from g""")
def route_facts(spark, d):
    """What each route is made of: known and unknown metres, and negative evidence of accessibility."""
    segments = _segments(spark, d)
    return routing.evidence(routing.routes(segments, _requests(spark, d), "avoid_known_steps_lower_ascent"), segments)


# -- the published network -------------------------------------------------------------------------------------------------------------

_WALKS = f"""with recursive n as materialized (select * from {_PATHS} where not back), g as materialized (select id, src, dst from {B.EDGES}), u as (select src, dst from g union all select dst, src from g),
 k(node, component) using key (node) as (select p_partkey, p_partkey from part union select u.dst, min(k.component) from k join u on u.src = k.node left join recurring.k o on o.node = u.dst where k.component < o.component group by u.dst),
 an as (select id place, (id * 37) % {_N} node from {B.sql('places')} where id <> 24), a as materialized (select an.*, component from an left join k using (node)),
 q as materialized (select id request, id from_place, case when id = 5 then id else (id + 7) % 25 end to_place from {B.sql('places')}),
 e as materialized (select request, f.node from_node, t.node to_node, case when from_place = to_place then 'same-place' when f.node is null then 'unknown-source-anchor' when t.node is null then 'unknown-destination-anchor' when f.component <> t.component then 'disconnected-components' end early
  from q left join a f on f.place = from_place left join a t on t.place = to_place),
 legs as materialized (select id, src, dst, distance_m w from n where eligible and not coalesce(steps, false) union all select concat('-', id), dst, src, distance_m from n where eligible and not coalesce(steps, false) and oneway = 'both'),
 r(origin, node, label) using key (origin, node) as (select distinct from_node, from_node, {{'c': 0e0, 'p': []::varchar[]}} from e where early is null union
  select r.origin, s.dst, min({{'c': r.label.c + s.w, 'p': list_append(r.label.p, s.id)}}) from r join legs s on s.src = r.node left join recurring.r o on o.origin = r.origin and o.node = s.dst
  where o.label is null or {{'c': r.label.c + s.w, 'p': list_append(r.label.p, s.id)}} < o.label group by r.origin, s.dst),
 f as materialized (select request, coalesce(early, case when r.label is null then 'no-route-for-profile' else 'ok' end) outcome, case when early is null then r.label.c end distance_m, case when early is null then r.label.p end path from e left join r on r.origin = e.from_node and r.node = e.to_node)"""


def _walks(spark, d) -> tuple[DataFrame, DataFrame]:
    n = B.n_nodes(spark, d)
    nodes, edges = B.graph_nodes(spark, d), B.graph_edges(spark, d)
    network = _segments(spark, d).filter("not back")
    places = B.places(spark, d)
    anchors = places.filter("id <> 24").select(F.col("id").alias("place"), ((F.col("id") * 37) % n).alias("node")).join(graph.components(nodes, edges), "node")
    asked = places.selectExpr("id request", "id from_place", "case when id = 5 then id else (id + 7) % 25 end to_place")
    return network, routing.plan_walks(network, anchors, asked, "avoid-mapped-steps")


@query(_WALKS + " select request, outcome, distance_m, array_to_string(path, ' ') legs from f")
def planned_walks(spark, d):
    """Walks without mapped steps between places, checked before they are searched, with an outcome that says what is missing."""
    return _walks(spark, d)[1].select("request", "outcome", "distance_m", F.array_join("path", " ").alias("legs"))


@query(_WALKS + """, l as (select request, n.* from (select request, unnest(path) leg from f where outcome = 'ok') x join n on n.id = ltrim(leg, '-')), s as (select request, coalesce(nullif(surface, ''), 'unknown') s, sum(distance_m) m from l group by all),
 t as (select request, string_agg(concat(s, ' ', cast(round(m, 1) as varchar)), ', ' order by s) surfaces from s group by 1)
 select request, any_value(surfaces) surfaces, count_if(coalesce(steps, false)) step_segments, coalesce(sum(case when steps then distance_m end), 0) step_m, count_if(steps is null) step_unknown_segments, count_if(accessibility_status = 'known_barrier_mobility_constraint') constraint_segments,
 count_if(starts_with(accessibility_status, 'unknown')) unverified_segments, coalesce(sum(case when accessibility_status = 'unknown_unmapped_connector' then distance_m end), 0) endpoint_m from l join t using (request) group by request""")
def walk_evidence(spark, d):
    """Surfaces, steps and unverified segments along planned walks."""
    network, found = _walks(spark, d)
    return routing.walk_evidence(found, network)


@query(_WALKS + """, l as (select request, nth, src, dst, leg from (select request, unnest(path) leg, unnest(range(len(path))) nth from f where outcome = 'ok') x join n on n.id = ltrim(leg, '-')),
 c as (select request, nth, case when starts_with(leg, '-') then [dst * 10, src + dst, src * 10] else [src * 10, src + dst, dst * 10] end c from l)
 select request, array_to_string(flatten(list(case when nth = 0 then c else c[2:] end order by nth)), ' ') coordinates from c group by request""")
def walk_coordinates(spark, d):
    """The coordinates of planned walks end to end, each joint once. Three made-up numbers stand for a segment's coordinates."""
    network, found = _walks(spark, d)
    network = network.withColumn("coordinates", F.array(F.col("src") * 10, F.col("src") + F.col("dst"), F.col("dst") * 10))
    return routing.stitched(found, network).select("request", F.array_join(F.transform("coordinates", lambda x: x.cast("string")), " ").alias("coordinates"))


# -- pairs of places -------------------------------------------------------------------------------------------------------------------

_PAIRS = f"""with recursive m as (select p.id place, n.node, round({Q.distance('p', 'n')}, 3) d from {B.sql('places')} p, {B.sql('nodes')} n), sn as materialized (select place, arg_min(node, (d, node)) node, min(d) snap_m from m group by place),
 b as materialized (select id, src, dst, w::double w from {B.EDGES} union all select id, dst, src, w from {B.EDGES}),
 r(origin, node, c) using key (origin, node) as (select distinct node, node, 0e0 from sn union select r.origin, b.dst, min(r.c + b.w) from r join b on b.src = r.node left join recurring.r o on o.origin = r.origin and o.node = b.dst where o.c is null or r.c + b.w < o.c group by r.origin, b.dst),
 p as materialized (select x.place a, y.place b, c net_m, round(x.snap_m + c + y.snap_m, 3) total_m from r join sn x on x.node = r.origin join sn y on y.node = r.node where x.place < y.place)"""


def _pairs(spark, d) -> DataFrame:
    nodes = B.shape(spark, d, "nodes").select(F.col("node").alias("id"), "lat", "lng")
    snapped = spatial.nearest(B.places(spark, d), nodes).select(F.col("id").alias("place"), F.col("place").alias("node"), F.col("distance_m").alias("snap_m"))
    return routing.pairwise(B.graph_edges(spark, d), snapped)


@query(_PAIRS + " select * from p")
def pairwise_routes(spark, d):
    """The shortest route for every pair of places, with the way to and from the network that they were snapped to."""
    return _pairs(spark, d)


@query(_PAIRS + """, n as (select a, b, total_m w from p), k as (select a, b from (select *, row_number() over (partition by e order by w, a, b) i from (select a e, * from n union all select b, * from n)) where i <= 3),
 q as (select a, b, w, row_number() over (order by w, a, b) nth from n),
 t(nth, labels, taken) as (select 0::bigint, (select map_from_entries(list((id, id))) from (select a id from n union select b from n)), []::bigint[] union all
  select q.nth, case when labels[q.a] = labels[q.b] then labels else map_from_entries(list_transform(map_entries(labels), lambda e: (e.key, case when e.value = labels[q.b] then labels[q.a] else e.value end))) end, case when labels[q.a] = labels[q.b] then taken else list_append(taken, q.nth) end from t join q on q.nth = t.nth + 1),
 s as (select unnest(taken) nth from (select taken from t order by nth desc limit 1)), u as (select q.a, q.b from s join q using (nth))
 select a, b, w, (a, b) in (select a, b from k) near, (a, b) in (select a, b from u) backbone from n where (a, b) in (select a, b from k) or (a, b) in (select a, b from u)""")
def adjacency_selection(spark, d):
    """Pairs among the three nearest of a place, and the least spanning forest over all pairs."""
    return routing.ranked_pairs(_pairs(spark, d).select("a", "b", F.col("total_m").alias("w")))


@query("select place, min(node) node from (select p_partkey node, unnest([p_partkey % 40, p_partkey % 7]) place from part) group by place")
def place_anchors(spark, d):
    """Each place's first path node."""
    nodes = B.graph_nodes(spark, d).select("node", F.array(F.col("node") % 40, F.col("node") % 7).alias("places"))
    return routing.place_anchors(nodes)


# -- topology --------------------------------------------------------------------------------------------------------------------------

_WAY = ["line way", "pos", "node", "case line % 8 when 0 then 'motorway' when 1 then 'steps' else 'path' end highway", "case line % 37 when 0 then 'no' when 1 then 'yes' end foot", "case line % 41 when 0 then 'private' end access"]
_BLOCK = "case when foot = 'no' then 'node_foot_no' when access in ('private', 'no') and not coalesce(foot in ('yes', 'designated', 'permissive'), false) then 'node_access_private_or_no_without_pedestrian_exception' end"
_A_IN, _B_IN = Q.in_ring("a.lat", "a.lng"), Q.in_ring("b.lat", "b.lng")
_TOPOLOGY = f"""with w as materialized (select {', '.join(_WAY)} from {B.sql('polylines')}), nd as materialized (select *, {_BLOCK} closed from {B.sql('nodes')}),
 pr as (select way, pos, node a, lead(node) over (partition by way order by pos) b, case when highway not in ('path', 'steps') then 'not_walkable' when foot = 'no' then 'foot_no' when access = 'private' and coalesce(foot <> 'yes', true) then 'access_restricted' else 'included' end reason from w),
 sc as materialized (select way, pos "index", pr.a, pr.b, case when {_A_IN} and {_B_IN} then 'inside' when {_A_IN} or {_B_IN} or {Q.crosses_ring(('a.lat', 'a.lng'), ('b.lat', 'b.lng'))} then 'crossing' end scope, reason, coalesce(a.closed, b.closed) block, round({Q.distance('a', 'b')}, 3) metres
  from pr join nd a on a.node = pr.a join nd b on b.node = pr.b),
 ad as (select * from sc where scope is not null and reason = 'included' and block is null), ru as (select *, "index" - row_number() over (partition by way order by "index") run from ad),
 ed as materialized (select *, lag("index") over x is null first, lead("index") over x is null last from ru window x as (partition by way, run order by "index")),
 en as (select a node, way, first run_end, scope = 'crossing' crossing from ed union all select b, way, last, scope = 'crossing' from ed),
 de as (select node, count(*) degree, count(distinct way) n_ways, bool_or(run_end) run_end, bool_or(crossing) crossing from en group by node),
 me as materialized (select node, degree, n_ways, array_to_string(list_filter([case when node in (select (id * 37) % {_N} from {B.sql('places')}) then 'route_projection_node' end, case when degree <> 2 then 'network_degree_not_two' end, case when n_ways > 1 then 'multiple_source_ways' end,
  case when foot is not null or access is not null or barrier is not null then 'source_node_tag_transition' end, case when run_end then 'selected_way_run_endpoint' end, case when crossing then 'boundary_crossing_endpoint' end], lambda x: x is not null), ' ') reasons from de left join nd using (node))"""


def _topology(spark, d) -> tuple[DataFrame, DataFrame]:
    n = B.n_nodes(spark, d)
    nodes = B.shape(spark, d, "nodes")
    pairs = topology.adjacencies(B.polylines(spark, d).selectExpr(*_WAY), nodes, B.RING)
    # the nodes' tags as the map that a reader of tiles gives
    tags = F.map_filter(F.create_map(F.lit("foot"), "foot", F.lit("access"), "access", F.lit("barrier"), "barrier"), lambda k, v: v.isNotNull())
    tagged = nodes.select("node", topology.has_relevant_tag(tags).alias("tagged"))
    used = B.places(spark, d).select(((F.col("id") * 37) % n).alias("node"))
    runs = topology.with_runs(topology.admitted(pairs))
    return runs, topology.meaningful_nodes(runs, tagged, used)


@query(_TOPOLOGY + ' select coalesce(case when reason <> \'included\' then reason end, block) reason, scope, count(*) n, count(distinct way) n_ways from sc where scope is not null and (reason <> \'included\' or block is not null) group by all')
def left_out_pairs(spark, d):
    """Pairs of way nodes in or across a polygon that aren't walkable, by reason."""
    pairs = topology.adjacencies(B.polylines(spark, d).selectExpr(*_WAY), B.shape(spark, d, "nodes"), B.RING)
    reason = F.coalesce(F.when(F.col("reason") != "included", F.col("reason")), F.col("block"))
    out = pairs.filter("reason <> 'included' or block is not null").groupBy(reason.alias("reason"), "scope")
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("way").alias("n_ways"))


@query(_TOPOLOGY + " select node, degree, n_ways, reasons from me")
def meaningful_nodes(spark, d):
    """Every node of the walkable network with its reasons to stand in the topology."""
    return _topology(spark, d)[1].select("node", "degree", "n_ways", F.array_join("reasons", " ").alias("reasons"))


@query(_TOPOLOGY + """, ch as (select ed.*, sum(case when a in (select node from me where reasons <> '') then 1 else 0 end) over (partition by way, run order by "index") chain from ed),
 ag as (select way, run, chain, list(a order by "index") n, arg_max(b, "index") last, count(*) n_pairs, round(sum(metres order by "index"), 3) metres, string_agg(distinct scope, ' ' order by scope) scopes from ch group by all)
 select concat('pathseg-way-', way, '-', n[1], '--', last, '-', substr(sha1(array_to_string(list_append(n, last), '/')), 1, 10)) id, way, n[1] from_node, last to_node, n_pairs, metres, scopes from ag""")
def topology_chains(spark, d):
    """Ways cut into chains between meaningful nodes, with six reasons to cut and ids that the nodes decide."""
    runs, nodes = _topology(spark, d)
    return topology.chains(runs, nodes.filter(F.size("reasons") > 0))


@query(f"""with o as (select id, src, dst, distance_m metres, 0 o from {B.SEGMENTS} where id like 'a%' union all select concat('new-', id), src, dst, distance_m, 1 from {B.SEGMENTS}), k as (select * from (select *, row_number() over (partition by src, dst, metres order by o, id) n from o) where n = 1)
 select k.id, k.src, k.dst, k.metres, case k.o when 0 then 'old' else 'new' end origin, min(b.id) reverse_id from k left join k b on b.src = k.dst and b.dst = k.src and b.metres = k.metres and b.src <> b.dst group by all""")
def merged_topology(spark, d):
    """An old topology and a wider one together, segments that both have once, each wired to the one that leads back."""
    s = B.segments(spark, d).select("id", "src", "dst", F.col("distance_m").alias("metres"))
    return topology.merged_scope(s.filter("id like 'a%'"), s.withColumn("id", F.concat(F.lit("new-"), "id")))


def _check_sql(checks: dict[str, str]) -> str:
    """A row for each check from the SQL of its offending ids, as contracts.checks() makes them."""
    one = lambda name, ids: f"select '{name}' check_id, count(*) = 0 pass, count(*) failures, coalesce((select string_agg(id, ' ' order by id) from (select cast(id as varchar) id from ({ids}) order by 1 limit {contracts.SAMPLE})), '') sample from ({ids})"
    return " union all ".join(one(*x) for x in checks.items())


#: What the checks must find in routes of which every fifth was damaged in one way or another.
_BAD_ROUTES = {
    "routes_found_by_both_policies": "select request id from f where request % 5 = 0 or request % 5 = 4 and (from_node is null or to_node is null)",
    "policy_never_worsens_steps": "select request id from f where request % 5 = 1 and outcome = 'ok'",
    "shortest_is_shortest": "select request id from f where request % 5 = 2 and outcome = 'ok'",
    "segments_are_admissible": "select request id from f where request % 5 = 3 and outcome = 'ok'",
    "same_endpoint_is_zero": "select request id from f where request % 5 = 3 and outcome = 'ok' and from_node = to_node",
    "unknown_endpoint_fails_closed": "select request id from f where request % 5 = 4 and (from_node is null or to_node is null)",
    "reversed_input_changes_nothing": "select request id from f where request % 5 = 4",
}


@query(_ROUTES + " " + _check_sql(_BAD_ROUTES))
def routing_checks(spark, d):
    """What must hold of routes under both policies, on routes some of which were damaged; a failing check names its requests."""
    segments, asked = _segments(spark, d), _requests(spark, d)
    policies = ["avoid_known_steps_lower_ascent", "shortest"]
    both = routing.cut(routing.routes_under(segments, asked, policies))
    soft, hard = (both.filter(F.col("policy") == p).drop("policy") for p in policies)
    facts = [routing.cut(routing.evidence(r, segments).select("request", F.col("known_step_m").alias("step_m"), "distance_m")) for r in (soft, hard)]
    hit = lambda k: F.col("request") % 5 == k
    longer = lambda c: F.concat(F.coalesce(c, F.array().cast("array<string>")), F.array(F.lit("zz")))
    again = hard.withColumn("path", F.when(hit(4), longer(F.col("path"))).otherwise(F.col("path")))
    steps = facts[0].withColumn("step_m", F.when(hit(1), F.col("step_m") + 1e9).otherwise(F.col("step_m")))
    far = facts[1].withColumn("distance_m", F.when(hit(2), F.col("distance_m") + 1e9).otherwise(F.col("distance_m")))
    worse = hard.withColumn("outcome", F.when(hit(0), "lost").otherwise(F.col("outcome")))
    soft = soft.withColumn("path", F.when(hit(3) & (F.col("outcome") == "ok"), longer(F.col("path"))).otherwise(F.col("path")))
    soft = soft.withColumn("outcome", F.when(hit(4) & (F.col("from_node").isNull() | F.col("to_node").isNull()), "ok").otherwise(F.col("outcome")))
    return routing.route_checks(soft, worse, hard, again, steps, far, routing.admissible(segments))


#: What the checks must find in a topology of which every tenth way or node was damaged. A made-up way may take the same nodes twice, which gives two chains of one name.
_CHAINS = f"""ch as (select ed.*, sum(case when a in (select node from me where reasons <> '') then 1 else 0 end) over (partition by way, run order by "index") chain from ed),
 ag as materialized (select way, run, chain, list(a order by "index") n, arg_max(b, "index") last, count(*) n_pairs from ch group by all),
 na as materialized (select concat('pathseg-way-', way, '-', n[1], '--', last, '-', substr(sha1(array_to_string(list_append(n, last), '/')), 1, 10)) id, way, n[1] a, last b from ag)"""
_BAD_TOPOLOGY = {
    "chain_ids_unique": "select id from na group by id having count(*) > 1",
    "chains_have_length": "select id from na where way % 10 = 1",
    "chain_ends_meaningful": "select a id from na where a % 10 = 7 union all select b from na where b % 10 = 7",
    "inner_nodes_pass_on": "select node id from me where node % 10 = 4 and reasons = '' or node % 10 = 7 and (degree <> 2 or n_ways <> 1)",
    "pairs_covered_once": "select distinct way id from na where way % 10 = 2",
    "scopes_known": "select way id from ed where way % 10 = 3",
    "degrees_match": "select node id from me where node % 10 = 4",
    "reasons_known": "select node id from me where node % 10 = 5",
    "runs_never_bridge": "select way id from ed where way % 10 = 6 group by way, run having count(*) > 1",
}


@query(_TOPOLOGY + ", " + _CHAINS + " " + _check_sql(_BAD_TOPOLOGY))
def topology_checks(spark, d):
    """What must hold of a topology that was cut into chains, re-derived from its pairs, on one some of which was damaged."""
    runs, nodes = _topology(spark, d)
    runs, nodes = routing.cut(runs), routing.cut(nodes)
    chains = routing.cut(topology.chains(runs, nodes.filter(F.size("reasons") > 0)))
    way, node = (lambda k: F.col("way") % 10 == k), (lambda k: F.col("node") % 10 == k)
    change = lambda df, c, when, to: df.withColumn(c, F.when(when, to).otherwise(F.col(c)))
    chains = change(change(chains, "metres", way(1), F.lit(-1.0)), "n_pairs", way(2), F.col("n_pairs") + 1)
    runs = change(change(runs, "scope", way(3), F.lit("elsewhere")), "index", way(6), F.col("index") * 2)
    nodes = change(change(nodes, "degree", node(4), F.col("degree") + 1), "reasons", node(5), F.array_append("reasons", F.lit("because")))
    nodes = change(nodes, "reasons", node(7), F.array().cast("array<string>"))
    return topology.chain_checks(runs, nodes, chains)
