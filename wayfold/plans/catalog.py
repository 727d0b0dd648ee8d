"""The query catalogue: each entry pairs a DataFrame query with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.functions import geo, normalize
from wayfold.operators import contracts, graph, search, sequences, spatial
from wayfold.plans import bindings as B
from wayfold.plans import sqltext as Q
from wayfold.plans.registry import oracle_sql, queries  # noqa: F401
from wayfold.plans.registry import query as _query
from wayfold.sources.layers import content_hash, table
from wayfold.streaming import proximity

_dist = Q.distance
_CUSTOMERS, _SUPPLIERS, _PLACES = B.sql("customers")[1:-1], B.sql("suppliers")[1:-1], B.sql("places")[1:-1]
_LINES, _EDGES = B.sql("polylines")[1:-1], B.EDGES[1:-1]
_BOTH = f"select id, src, dst, w, steps from ({_EDGES}) union all select id, dst, src, w, steps from ({_EDGES})"


# -- joins and geometry --------------------------------------------------------------------------------------------------------------


@_query(f"""with p as (select c.id, s.id other, round({_dist('c', 's')}, 3) distance_m from ({_CUSTOMERS}) c, ({_SUPPLIERS}) s),
 r as (select *, row_number() over (partition by id order by distance_m, other) rank from p where distance_m <= 800)
 select id, other, distance_m, cast(rank as int) rank from r where rank <= 3""")
def proximity_topk(spark, d):
    """Each customer's three nearest suppliers within 800 m."""
    return spatial.proximity_topk(B.customers(spark, d), B.suppliers(spark, d), 800.0, 3).select("id", "other", "distance_m", "rank")


@_query(f"""with p as (select c.id, s.id place, round({_dist('c', 's')}, 3) distance_m from ({_CUSTOMERS}) c, ({_PLACES}) s)
 select id, arg_min(place, (distance_m, place)) place, min(distance_m) distance_m from p group by id""")
def nearest_place(spark, d):
    """Each customer's nearest place."""
    return spatial.nearest(B.customers(spark, d), B.places(spark, d)).select("id", "place", "distance_m")


@_query(f"""with p as (select c.id, s.id place, round({_dist('c', 's')}, 3) distance_m from ({_CUSTOMERS}) c, ({_PLACES}) s),
 n as (select id, arg_min(place, (distance_m, place)) place, min(distance_m) distance_m from p group by id)
 select id, case when distance_m <= 150 then place end place, case when distance_m <= 150 then distance_m end distance_m from n""")
def nearest_within_radius(spark, d):
    """The nearest place, if it is within 150 m."""
    return spatial.nearest(B.customers(spark, d), B.places(spark, d), 150.0).select("id", "place", "distance_m")


@_query(f"select id, {Q.in_ring('lat', 'lng')} inside, round({Q.ring_distance('lat', 'lng')}, 3) boundary_m from ({_CUSTOMERS})")
def containment_join(spark, d):
    """Which customers lie in a polygon, and how far its boundary is."""
    return spatial.contained(B.customers(spark, d), B.RING).select("id", "inside", "boundary_m")


@_query(f"select c.id, round({_dist('c', 's')}, 3) metres, round({_dist('c', 's')}, 3) clamped_metres, c.lng between 9.39 and 9.41 in_span from ({_CUSTOMERS}) c join ({_SUPPLIERS}) s on c.id = s.id")
def haversine_pairs(spark, d):
    """Distances of paired points; longitudes within bounds."""
    c, s = B.customers(spark, d).alias("c"), B.suppliers(spark, d).alias("s")
    at = [F.col(x) for x in ("c.lat", "c.lng", "s.lat", "s.lng")]
    j = c.join(s, F.col("c.id") == F.col("s.id"))
    return j.select("c.id", F.round(geo.haversine(*at), 3).alias("metres"), F.round(geo.surface_distance(*at), 3).alias("clamped_metres"), geo.longitude_between(F.col("c.lng"), F.lit(9.39), F.lit(9.41)).alias("in_span"))


@_query(f"select id, cast(floor((lng + 180) / 360 * 65536) as bigint) x, cast(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 65536) as bigint) y from ({_CUSTOMERS})")
def tile_of_points(spark, d):
    """Web Mercator tiles at zoom 16."""
    x, y = geo.tile_xy(F.col("lat"), F.col("lng"), 16)
    return B.customers(spark, d).select("id", x.alias("x"), y.alias("y"))


@_query("""with q as (select p_partkey id, cast(round_even((p_retailprice / 10 + 32768) * 256, 0) as bigint) q from part)
 select id, q >> 16 r, (q >> 8) & 255 g, q & 255 b, ((q >> 16) * 65536 + ((q >> 8) & 255) * 256 + (q & 255)) / 256e0 - 32768 z from q""")
def terrarium_roundtrip(spark, d):
    """Elevations as red, green, blue and back."""
    r, g, b = geo.terrarium(F.col("p_retailprice") / 10)
    rgb = table(spark, d, "part").select(F.col("p_partkey").alias("id"), r.alias("r"), g.alias("g"), b.alias("b"))
    return rgb.withColumn("z", geo.from_terrarium(F.col("r"), F.col("g"), F.col("b")))


@_query(f"select id, round({Q.krueger('lat', 'lng')[0]}, 3) east, round({Q.krueger('lat', 'lng')[1]}, 3) north from ({_CUSTOMERS})")
def utm_forward(spark, d):
    """Easting and northing of customers in zone 32."""
    east, north = geo.utm32(F.col("lat"), F.col("lng"))
    return B.customers(spark, d).select("id", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@_query("""with c as (select * from (values (0.004e0, 14), (0.002e0, 15), (0.001e0, 16)) v(cell, zoom)),
 p as (""" + _CUSTOMERS + """)
 select zoom, cast(floor(lat / cell) as bigint) cell_y, cast(floor(lng / cell) as bigint) cell_x, count(*) n, round(avg(lat), 6) lat, round(avg(lng), 6) lng,
 least(36, cast(22 + round(log2(count(*) + 1) * 2) as int)) icon from p, c group by all""")
def grid_clusters(spark, d):
    """Clusters of customers by grid cell at three zooms."""
    points = B.customers(spark, d)
    parts = [spatial.grid_clusters(points, cell).select(F.lit(zoom).alias("zoom"), "*") for cell, zoom in ((0.004, 14), (0.002, 15), (0.001, 16))]
    return parts[0].union(parts[1]).union(parts[2])


# -- sequences --------------------------------------------------------------------------------------------------------------------------


@_query(f"""with v as ({_LINES}), s as (select a.line, a.pos, coalesce({_dist('b', 'a')}, 0) step from v a left join v b on a.line = b.line and b.pos = a.pos - 1)
 select line, count(*) n_vertices, round(sum(step order by pos), 3) length_m from s group by line""")
def polyline_length(spark, d):
    """Vertices and length of each polyline."""
    return sequences.lengths(B.polylines(spark, d))


@_query(f"""with v as ({_LINES}), s as (select line, z, coalesce(z - lag(z) over (partition by line order by pos), 0) dz from v)
 select line, round(sum(greatest(dz, 0)), 3) ascent_m, round(sum(greatest(-dz, 0)), 3) descent_m, min(z) low_m, max(z) high_m from s group by line""")
def ascent_descent(spark, d):
    """Ascent, descent, lowest and highest point."""
    return sequences.climbs(B.polylines(spark, d))


@_query(f"""with v as ({_LINES}), f as (select *, case when lag(surface) over w is not distinct from surface and lag(steps) over w is not distinct from steps and lag(pos) over w is not null then 0 else 1 end f from v window w as (partition by line order by pos)),
 r as (select *, sum(f) over (partition by line order by pos) run from f)
 select line, cast(run as bigint) run, surface, steps, count(*) n, round(sum(d), 3) distance_m from r group by all""")
def run_length_segments(spark, d):
    """Runs of equal surface and steps along each polyline."""
    return sequences.run_lengths(B.polylines(spark, d), ["surface", "steps"])


@_query(f"""with recursive v as materialized ({_LINES}), s as materialized (select a.line, a.pos, coalesce({_dist('b', 'a')}, 0) step from v a left join v b on a.line = b.line and b.pos = a.pos - 1),
 m as materialized (select line, max(pos) last from v group by line),
 r as (select line, pos, 0e0 acc, true kept from s where pos = 1 union all
  select s.line, s.pos, case when r.acc + s.step >= 900 then 0e0 else r.acc + s.step end, r.acc + s.step >= 900 from r join s on s.line = r.line and s.pos = r.pos + 1)
 select r.line, r.pos from r join m on m.line = r.line where kept or pos = last""")
def resample_by_distance(spark, d):
    """Vertices kept by an accumulator that starts anew at each kept one."""
    return sequences.keep_every(B.polylines(spark, d), 900.0)


@_query(f"""with v as ({_LINES}), s as (select a.line, a.pos, a.lat, a.lng, coalesce({_dist('b', 'a')}, 0) step from v a left join v b on a.line = b.line and b.pos = a.pos - 1),
 c as (select *, sum(step) over (partition by line order by pos) along from s),
 l as (select *, lead(along) over w to_m, lead(lat) over w lat2, lead(lng) over w lng2, lead(pos) over w np, max(along) over (partition by line) length, max(pos) over (partition by line) last from c window w as (partition by line order by pos)),
 u as (select *, greatest(1, cast(ceil(length / 500) as int)) n from l where np is not null and length > 0 and to_m > along),
 k as (select *, length / n gap from u),
 e as (select *, unnest(range(cast(ceil(along / gap) as int), 1 + least(n, case when np = last then n else cast(ceil(to_m / gap) as int) - 1 end))) k from k)
 select line, cast(k as int) k, round(least(k * gap, length), 3) at_m, round(lat + (lat2 - lat) * least(1e0, (least(k * gap, length) - along) / (to_m - along)), 8) lat,
 round(lng + (lng2 - lng) * least(1e0, (least(k * gap, length) - along) / (to_m - along)), 8) lng from e""")
def equal_spacing_resample(spark, d):
    """Points about every 500 m along each polyline, interpolated."""
    return sequences.resample(B.polylines(spark, d), 500.0).drop("gap_m")


@_query(f"""with v as (select line, pos, coalesce(surface, 'unknown') surface, steps, d, case node % 45 when 0 then 'no' end wheelchair, case node % 50 when 0 then 'bad' when 1 then 'good' end smoothness, case node % 60 when 0 then 'hiking' when 1 then '' end sac from ({_LINES})),
 g as (select line, surface, sum(d) m, min(pos) first from v group by all),
 p as (select line, coalesce(arg_max(surface, (m, -first)) filter (surface <> 'unknown'), 'unknown') primary_surface, round(sum(m), 3) total_m, string_agg(concat(surface, ' ', cast(round(m, 1) as varchar)), ', ' order by surface) mix from g group by line),
 a as (select line, case when bool_or(steps) then 'not_step_free' when bool_or(wheelchair = 'no') then 'not_wheelchair_accessible' when bool_or(surface in ('dirt', 'grass')) or bool_or(smoothness in ('bad', 'very_bad', 'horrible', 'very_horrible', 'impassable')) or bool_or(sac <> '') then 'limited'
  when bool_and(surface in ('paved', 'gravel')) then 'potentially_step_free_mapped_path' else 'unknown' end access from v group by line)
 select line, primary_surface, total_m, mix, access from p join a using (line)""")
def surface_mix(spark, d):
    """Each line's surfaces, the main one (known before unknown, the first seen on a tie), and the accessibility ladder."""
    evidence = ("case node % 45 when 0 then 'no' end wheelchair", "case node % 50 when 0 then 'bad' when 1 then 'good' end smoothness", "case node % 60 when 0 then 'hiking' when 1 then '' end sac")
    v = B.polylines(spark, d).selectExpr("line", "pos", "coalesce(surface, 'unknown') surface", "steps", "d", *evidence)
    return sequences.surface_summary(v)


@_query(f"""with v as (select line, pos, (lng - 9.405e0) * 111320e0 * cos(radians(51.315e0)) x, (lat - 51.315e0) * 111320e0 y from ({_LINES})),
 d as (select *, lead(x) over w - x dx, lead(y) over w - y dy from v window w as (partition by line order by pos)),
 l as (select *, sqrt(dx * dx + dy * dy) len from d), k as (select *, coalesce(sum(len) over (partition by line order by pos rows between unbounded preceding and 1 preceding), 0) walked from l),
 t as (select *, least(greatest(-(x * dx + y * dy) / (len * len), 0e0), 1e0) t from k where len > 0),
 o as (select line, pos, round(sqrt(pow(x + t * dx, 2) + pow(y + t * dy, 2)), 3) off_m, round(walked + len * t, 3) along_m from t),
 r as (select *, row_number() over (partition by line order by off_m, pos) n from o) select line, pos, off_m, along_m from r where n = 1""")
def best_projection(spark, d):
    """Where each polyline passes a point nearest, and how far along that is."""
    return sequences.project(B.polylines(spark, d), 51.315, 9.405)


# -- aggregations ------------------------------------------------------------------------------------------------------------------------


@_query("""select o_custkey id, case when count(distinct nullif(s, '')) > 1 then 'mixed' else min(nullif(s, '')) end status, count_if(s = 'F') finished, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) priorities
 from (select o_custkey, o_orderpriority, case when o_orderkey % 3 = 0 then '' else o_orderstatus end s from orders) group by o_custkey""")
def single_or_mixed(spark, d):
    """One value or 'mixed', conditional counts, sorted distinct lists."""
    orders = table(spark, d, "orders").withColumn("s", F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")))
    return orders.groupBy(F.col("o_custkey").alias("id")).agg(normalize.one_or_mixed(F.col("s")).alias("status"), F.count_if(F.col("s") == "F").alias("finished"), F.concat_ws(",", F.array_sort(F.collect_set("o_orderpriority"))).alias("priorities"))


@_query("select l_orderkey, l_linenumber, count(*) n from lineitem group by all having count(*) > 1")
def duplicate_refs(spark, d):
    """Keys that come more than once."""
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@_query("""select f family, coalesce(n, 0) n from (values ('access'), ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY'), ('transit')) v(f)
 left join (select c_mktsegment, count(*) n from customer group by 1) c on c_mktsegment = f""")
def family_counts(spark, d):
    """Counts over a fixed domain, zero where nothing is."""
    domain = spark.createDataFrame([(x,) for x in ("access", "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "transit")], "family string")
    counts = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return domain.join(counts, domain.family == counts.c_mktsegment, "left").select("family", F.coalesce("n", F.lit(0)).alias("n"))


@_query("""with r as (select o_orderpriority, o_totalprice v, row_number() over (partition by o_orderpriority order by o_totalprice) i, count(*) over (partition by o_orderpriority) n from orders)
 select o_orderpriority, max(case when i = cast(ceil(0.5 * n) as bigint) then v end) p50, max(case when i = cast(ceil(0.95 * n) as bigint) then v end) p95, max(v) largest, min(v) least from r group by 1""")
def nearest_rank_percentile(spark, d):
    """Nearest-rank percentiles, not interpolated: the value at rank ceil(q n)."""
    return sequences.nearest_ranks(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", {"p50": 0.5, "p95": 0.95}).select("o_orderpriority", "p50", "p95", F.col("high").alias("largest"), F.col("low").alias("least"))


@_query(f"with e as ({_EDGES}), x as (select src node, dst other from e union all select dst, src from e) select node, count(*) degree, count(distinct other) neighbours, count(distinct other) >= 3 junction from x group by node")
def junctions(spark, d):
    """Degree, distinct neighbours, junctions."""
    return graph.degrees(B.graph_edges(spark, d))


# -- filters and projections -------------------------------------------------------------------------------------------------------------

_TAGS = B.sql("tags")[1:-1]


def _tags(spark, d) -> DataFrame:
    return B.shape(spark, d, "tags")


@_query(f"""select id, case when highway is null or highway not in ('footway','path','steps','pedestrian','track','service','living_street','residential','unclassified','tertiary') then 'not_walkable'
 when foot = 'no' then 'foot_no' when access in ('private','no') and coalesce(foot not in ('yes','designated','permissive'), true) then 'access_restricted' else 'included' end reason from ({_TAGS})""")
def walkable_filter(spark, d):
    """the first reason to leave a way out."""
    return _tags(spark, d).select("id", normalize.pedestrian_policy(F.col("highway"), F.col("foot"), F.col("access")).alias("reason"))


@_query(f"""with t as (select *, trim(regexp_replace(incline, '%$', '')) n from ({_TAGS}))
 select id, case when highway = 'steps' then 'stone_steps' when surface in ('asphalt','sett') then 'paved' when surface = 'gravel' then 'gravel' when surface = 'mud' then 'dirt' when surface = 'grass' then 'grass' else 'unknown' end surface,
 case when id % 10 = 0 then 'unknown_unmapped_connector' when highway = 'steps' then 'known_steps' when wheelchair = 'no' then 'known_wheelchair_no' when barrier in ('stile', 'turnstile') then 'known_barrier_mobility_constraint' else 'unknown_not_field_verified' end access,
 case when coalesce(incline, '') = '' then null when direction = 'forward' then incline when direction = 'reverse' then
  case when lower(incline) = 'up' then 'down' when lower(incline) = 'down' then 'up' when try_cast(n as double) is not null then concat(printf('%g', -try_cast(n as double)), case when right(incline, 1) = '%' then '%' else '' end) end end incline,
 try_cast(replace(trim(width), ',', '.') as double) width from t""")
def normalized_tags(spark, d):
    """Surfaces, accessibility ladder with barriers along the segment, route-relative inclines in short numbers, permissive numbers."""
    c = F.col
    barriers = F.array_compact(F.array(F.when(c("id") % 2 == 0, "gate"), c("barrier")))
    return _tags(spark, d).select("id", normalize.surface_bucket(c("surface"), c("highway")).alias("surface"), normalize.segment_access(c("id") % 10 == 0, c("highway") == "steps", c("wheelchair"), barriers).alias("access"), normalize.reverse_incline(c("incline"), c("direction")).alias("incline"), normalize.number_or_null(c("width")).alias("width"))


@_query("""select p_partkey id, case when regexp_matches(p_name, '^red') then 'reds' when regexp_matches(p_name, 'ring$') then 'rings' when regexp_matches(p_name, 'o') then 'round' else 'other' end sector from part""")
def sector_classify(spark, d):
    """The first pattern that matches names the sector."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), normalize.first_match(F.col("p_name"), [("^red", "reds"), ("ring$", "rings"), ("o", "round")], "other").alias("sector"))


# -- integrity ---------------------------------------------------------------------------------------------------------------------------


@_query("select o_orderkey id from orders where o_orderkey not in (select l_orderkey from lineitem)")
def referential_orphans(spark, d):
    """Orders without an item."""
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.col("o_orderkey").alias("id"))


@_query(f"with e as ({_EDGES}) select a.id, b.id reverse_id, a.w - b.w difference from e a join e b on a.src = b.dst and a.dst = b.src where a.src < a.dst")
def reverse_pair_audit(spark, d):
    """Edges whose reverse is an edge too, and how far their measures differ."""
    a, b = B.graph_edges(spark, d).alias("a"), B.graph_edges(spark, d).alias("b")
    j = a.join(b, (F.col("a.src") == F.col("b.dst")) & (F.col("a.dst") == F.col("b.src"))).filter("a.src < a.dst")
    return j.select("a.id", F.col("b.id").alias("reverse_id"), (F.col("a.w") - F.col("b.w")).alias("difference"))


@_query("""select concat('region-', r_regionkey) id, 'region' kind, r_name name, cast(null as varchar) parent from region union all
 select concat('nation-', n_nationkey), 'nation', n_name, concat('region-', n_regionkey) from nation union all
 select concat('supplier-', s_suppkey), 'supplier', s_name, concat('nation-', s_nationkey) from supplier union all
 select concat('customer-', c_custkey), 'customer', c_name, concat('nation-', c_nationkey) from customer""")
def entity_union(spark, d):
    """Entities of four layers in one table."""
    e = lambda t, k, name, parent=None: table(spark, d, t).select(F.concat(F.lit(f"{t}-"), k).alias("id"), F.lit(t).alias("kind"), F.col(name).alias("name"), *([F.concat(F.lit(f"{parent[0]}-"), parent[1]).alias("parent")] if parent else []))
    layers = [e("nation", "n_nationkey", "n_name", ("region", "n_regionkey")), e("supplier", "s_suppkey", "s_name", ("nation", "s_nationkey")), e("customer", "c_custkey", "c_name", ("nation", "c_nationkey"))]
    out = e("region", "r_regionkey", "r_name")
    for layer in layers:
        out = out.unionByName(layer, allowMissingColumns=True)
    return out


@_query("""with k as (select c_custkey k, 'customer' layer from customer union all select s_suppkey, 'supplier' from supplier union all select p_partkey, 'part' from part)
 select k, count(distinct layer) layers, string_agg(distinct layer, ',' order by layer) names from k group by k having count(distinct layer) > 1""")
def id_disjointness(spark, d):
    """Keys that several layers use."""
    keys = [table(spark, d, t).select(F.col(c).alias("k"), F.lit(t).alias("layer")) for t, c in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"))]
    out = keys[0].union(keys[1]).union(keys[2]).groupBy("k").agg(F.count_distinct("layer").alias("layers"), F.concat_ws(",", F.array_sort(F.collect_set("layer"))).alias("names"))
    return out.filter("layers > 1")


@_query("""(select 'only_open' side, o_custkey k from orders where o_orderstatus = 'O' except select 'only_open', o_custkey from orders where o_orderstatus = 'F') union all
 (select 'only_finished', o_custkey from orders where o_orderstatus = 'F' except select 'only_finished', o_custkey from orders where o_orderstatus = 'O')""")
def set_audit(spark, d):
    """What either side has and the other hasn't."""
    of = lambda status: table(spark, d, "orders").filter(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("k"))
    return of("O").subtract(of("F")).select(F.lit("only_open").alias("side"), "k").union(of("F").subtract(of("O")).select(F.lit("only_finished"), "k"))


@_query("""select 'orders_priced' check_id, count_if(not coalesce(o_totalprice > 0, false)) = 0 pass, count_if(not coalesce(o_totalprice > 0, false)) failures from orders union all
 select 'orders_have_items', count(*) = 0, count(*) from orders where o_orderkey not in (select l_orderkey from lineitem) union all
 select 'unique_item_keys', count(*) = 0, count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1) union all
 select 'discount_in_range', count_if(not coalesce(l_discount between 0 and 0.1, false)) = 0, count_if(not coalesce(l_discount between 0 and 0.1, false)) from lineitem union all
 select 'customers_have_nation', count(*) = 0, count(*) from customer where c_nationkey not in (select n_nationkey from nation)""")
def constraint_report(spark, d):
    """A row for each check of the order tables, with whether it passes and how many rows fail."""
    orders, items, customers = (table(spark, d, t) for t in ("orders", "lineitem", "customer"))

    def check(name, failing):
        return failing.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("check_id"), (F.col("failures") == 0).alias("pass"), "failures")

    checks = [
        check("orders_priced", orders.filter(~F.coalesce(F.col("o_totalprice") > 0, F.lit(False)))),
        check("orders_have_items", orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")),
        check("unique_item_keys", items.groupBy("l_orderkey", "l_linenumber").count().filter("count > 1")),
        check("discount_in_range", items.filter(~F.coalesce(F.col("l_discount").between(0, 0.1), F.lit(False)))),
        check("customers_have_nation", customers.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left_anti")),
    ]
    out = checks[0]
    for more in checks[1:]:
        out = out.union(more)
    return out


_RULES = {
    "source_named": "event_type is not null and event_type <> ''",
    "value_finite": "value is not null and abs(value) < 1e9",
    "null_is_not_zero": "value is null or value <> 0",
    "accuracy_range": "k between 0 and 200",
    "exact_needs_number": "not (k % 17 = 0 and k > 50)",
}


@_query("with e as (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) k from events) " + " union all ".join(f"select '{n}' rule, count(*) checked, count_if(not coalesce({r}, false)) failures, min(case when not coalesce({r}, false) then event_id end) first_failure from e" for n, r in _RULES.items()))
def rule_report(spark, d):
    """A row for each rule on events: rows checked, rows that fail (unknown fails), and the first of them. One scan for all rules."""
    events = table(spark, d, "events").withColumn("k", F.expr("cast(regexp_extract(props, '([0-9]+)', 1) as int)"))
    return contracts.report(events, {n: F.expr(r) for n, r in _RULES.items()}, "event_id")


def _hash_sql(layer: str, columns: list[str]) -> str:
    text = " || ".join(f"coalesce(concat(length(cast({c} as varchar)), ':', cast({c} as varchar)), '-')" for c in sorted(columns))
    sums = ", ".join(f"coalesce(cast(sum(('0x' || substr(h, {a}, 8))::bigint) as varchar), '0')" for a in (1, 9, 17, 25))
    return f"select '{layer}' layer, count(*) n_rows, sha256(concat_ws('-', count(*), {sums})) content_hash from (select sha256({text}) h from {layer})"


_HASHED = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "supplier": ["s_suppkey", "s_name", "s_nationkey"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]}


@_query(" union all ".join(_hash_sql(t, c) for t, c in _HASHED.items()))
def layer_hash(spark, d):
    """Content hashes of all layers' rows, whatever the order of rows and files."""
    out = None
    for name, columns in _HASHED.items():
        one = content_hash(table(spark, d, name).select(*columns), name)
        out = one if out is None else out.unionByName(one)
    return out


# -- ranking and search ------------------------------------------------------------------------------------------------------------------

_TIER = lambda f, base: f"case when lower({f}) = '' then null when lower({f}) = 'red' then {base} when starts_with(lower({f}), 'red') then {base + 1} when contains(lower({f}), 'red') then {base + 2} end"


@_query(f"""with h as (select p_partkey id, p_name title, least({_TIER('p_name', 0)}, {_TIER('p_type', 3)}, {_TIER('p_brand', 3)}) score from part)
 select id, title, cast(score as int) score, (select count(*) from h where score is not null) total from h where score is not null order by score, title, id limit 80""")
def search_rank(spark, d):
    """The 80 best parts for a word, by field and kind of match."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), "p_type", "p_brand")
    matched = search.score("Réd ", F.col("title"), [F.col("p_type"), F.col("p_brand")], [], [])
    return search.rank(part, matched, order=[F.col("title"), F.col("id")], limit=80).select("id", "title", F.col("score").cast("int").alias("score"), "total")


@_query(f"select p_brand, count(*) n, min(least({_TIER('p_name', 0)}, {_TIER('p_type', 3)})) best from part where {_TIER('p_name', 0)} is not null or {_TIER('p_type', 3)} is not null group by p_brand")
def search_categories(spark, d):
    """Matches by category."""
    part = table(spark, d, "part").withColumn("s", search.score("red", F.col("p_name"), [F.col("p_type")], [], []))
    return part.filter("s is not null").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.min("s").cast("int").alias("best"))


@_query("select doc_id, lang from documents where contains(lower(text), 'license')")
def haystack_filter(spark, d):
    """Documents that contain a string, in whole texts."""
    return table(spark, d, "documents").filter(F.contains(F.lower("text"), F.lit("license"))).select("doc_id", "lang")


@_query("""with r as (select l_orderkey, l_partkey, l_extendedprice, l_quantity, row_number() over (partition by l_orderkey order by l_extendedprice nulls last, l_quantity nulls last, l_partkey, l_suppkey, l_linenumber) rank from lineitem)
 select l_orderkey, l_partkey, l_extendedprice, cast(rank as int) rank from r where rank <= 2""")
def route_comparison(spark, d):
    """The two best options of each group by a chain of measures, missing ones last."""
    by = W.partitionBy("l_orderkey").orderBy(F.asc_nulls_last("l_extendedprice"), F.asc_nulls_last("l_quantity"), "l_partkey", "l_suppkey", "l_linenumber")
    return table(spark, d, "lineitem").withColumn("rank", F.row_number().over(by)).filter("rank <= 2").select("l_orderkey", "l_partkey", "l_extendedprice", "rank")


_KIND = "case w % 4 when 0 then 'created' when 1 then 'member_of' when 2 then 'located_at' else 'near' end"


@_query(f"""with e as (select id, src, dst, {_KIND} kind from ({_EDGES})), i as (select src entity, id, dst other, kind from e union all select dst, id, src, kind from e),
 f as (select *, row_number() over (partition by entity, other order by id) n from i where entity <> other),
 p as (select *, row_number() over (partition by entity order by case kind when 'created' then 0 when 'member_of' then 3 when 'located_at' then 4 else 99 end, id, other) place from f where n = 1)
 select entity, id, other, kind, cast(place as int) place from p where place <= 3""")
def journey(spark, d):
    """The next stops from each entity, by the kind of relation."""
    relations = B.graph_edges(spark, d).selectExpr("id", "src", "dst", f"{_KIND} kind")
    return search.journey(relations, {"created": 0, "member_of": 3, "located_at": 4}, 3).select("entity", "id", "other", "kind", "place")


@_query("select c_custkey, c_name, (select count(*) from customer) > 40 has_more from customer order by c_name, c_custkey limit 20 offset 20")
def paged_result(spark, d):
    """The second page of twenty, and whether there are more."""
    c = table(spark, d, "customer")
    n = c.agg((F.count(F.lit(1)) > 40).alias("has_more")).withColumn("_one", F.lit(1))
    page = c.orderBy("c_name", "c_custkey").offset(20).limit(20).select("c_custkey", "c_name", F.lit(1).alias("_one"))
    return page.join(F.broadcast(n), "_one").drop("_one")  # the count is one row


# -- graphs ------------------------------------------------------------------------------------------------------------------------------


@_query(f"""with recursive b as materialized ({_BOTH}),
 r(node, component) using key (node) as (select p_partkey, p_partkey from part union select b.dst, min(r.component) from r join b on b.src = r.node left join recurring.r k on k.node = b.dst where r.component < k.component group by b.dst)
 select node, component from r""")
def connected_components(spark, d):
    """Each node's component, by its least node."""
    return graph.components(B.graph_nodes(spark, d), B.graph_edges(spark, d))


@_query(f"""with recursive b as materialized ({_BOTH}),
 r(node, component) using key (node) as (select p_partkey, p_partkey from part union select b.dst, min(r.component) from r join b on b.src = r.node left join recurring.r k on k.node = b.dst where r.component < k.component group by b.dst),
 s as (select component, count(*) size, sum(('0x' || substr(md5(cast(node as varchar)), 1, 8))::bigint) digest from r group by 1),
 e as (select r.component, count(*) n from ({_EDGES}) e join r on r.node = e.src group by 1)
 select s.component, concat('pathcomponent-', substr(sha1(concat_ws('/', s.component, size, digest)), 1, 12)) component_id, size, coalesce(n, 0) n_edges from s left join e using (component) order by size desc, s.component""")
def component_report(spark, d):
    """Components with a name that their members decide, sizes and edges, largest first."""
    nodes, edges = B.graph_nodes(spark, d), B.graph_edges(spark, d)
    return graph.component_sizes(graph.components(nodes, edges), edges).orderBy(F.desc("size"), "component")


@_query(f"""with recursive b as materialized ({_BOTH}),
 r(node, hops) using key (node) as (select cast(0 as bigint), 0 union select b.dst, min(r.hops + 1) from r join b on b.src = r.node left join recurring.r k on k.node = b.dst where k.hops is null or r.hops + 1 < k.hops group by b.dst)
 select node, hops from r""")
def reachability(spark, d):
    """Hops from node 0."""
    edges = graph.mirrored(B.graph_edges(spark, d))
    return graph.shortest(edges, 0, [F.lit(1)]).select("node", "hops")


@_query(f"""with recursive b as materialized (select src, dst, min(w) w from ({_BOTH}) group by 1, 2),
 r(node, cost) using key (node) as (select cast(0 as bigint), cast(0 as double) union
  select b.dst, min(r.cost + b.w) from r join b on b.src = r.node left join recurring.r k on k.node = b.dst where k.cost is null or r.cost + b.w < k.cost group by b.dst)
 select node, cost from r""")
def shortest_paths(spark, d):
    """Least distances from node 0."""
    edges = graph.mirrored(B.graph_edges(spark, d))
    return graph.shortest(edges, 0, [F.col("w")]).select("node", F.col("cost_0").alias("cost"))


@_query(f"""with recursive b as materialized (select src, dst, min({{'s': case when steps then w else 0 end::double, 'w': w::double}}) c from ({_BOTH}) group by 1, 2),
 r(node, cost) using key (node) as (select cast(0 as bigint), {{'s': 0e0, 'w': 0e0}} union
  select b.dst, min({{'s': r.cost.s + b.c.s, 'w': r.cost.w + b.c.w}}) from r join b on b.src = r.node left join recurring.r k on k.node = b.dst where k.cost is null or {{'s': r.cost.s + b.c.s, 'w': r.cost.w + b.c.w}} < k.cost group by b.dst)
 select node, cost.s cost_0, cost.w cost_1 from r""")
def step_avoiding_routes(spark, d):
    """Least paths by (distance on steps, distance) over all parts; test_graphs follows the parents back."""
    edges = graph.mirrored(B.graph_edges(spark, d))
    return graph.shortest(edges, 0, [F.when(F.col("steps"), F.col("w")).otherwise(0), F.col("w")]).select("node", "cost_0", "cost_1")


@_query(f"""with recursive q as materialized (select src + 1 a, dst + 1 b, row_number() over (order by w, id) nth from ({_EDGES}) where src <> dst),
 t(nth, labels, taken) as (select 0::bigint, (select list(p_partkey order by p_partkey) from part), []::bigint[] union all
  select q.nth, case when labels[q.a] = labels[q.b] then labels else list_transform(labels, lambda x: case when x = labels[q.b] then labels[q.a] else x end) end, case when labels[q.a] = labels[q.b] then taken else list_append(taken, q.nth) end from t join q on q.nth = t.nth + 1),
 e as (select id, src, dst, w, row_number() over (order by w, id) nth from ({_EDGES}) where src <> dst) select src, dst, w, id from e where nth in (select unnest(taken) from t where nth = (select max(nth) from q))""")
def spanning_backbone(spark, d):
    """The least spanning forest, over all parts."""
    return graph.minimum_spanning_forest(B.graph_nodes(spark, d), B.graph_edges(spark, d))


@_query(f"""with recursive e as materialized (select id, src, dst, w from (select *, row_number() over (partition by least(src, dst), greatest(src, dst) order by id) n from ({_EDGES}) where src <> dst) where n = 1),
 g as (select node from (select src node, dst other from e union all select dst, src from e) group by node having count(distinct other) = 2),
 b as materialized (select src, dst from (select src, dst from e union all select dst, src from e) where src in (select node from g) and dst in (select node from g)),
 r(node, seen) as (select node, node from g union select r.node, b.dst from r join b on b.src = r.seen), l as materialized (select node, min(seen) chain from r group by node)
 select coalesce(cast(a.chain as varchar), cast(z.chain as varchar), e.id) chain, count(*) n_edges, cast(sum(w) as bigint) w from e left join l a on a.node = e.src left join l z on z.node = e.dst group by 1""")
def chain_compress(spark, d):
    """By degree alone: edges joined up through nodes that only pass a path on."""
    return graph.chains(B.graph_edges(spark, d))


@_query(f"with e as ({_EDGES}), r as (select *, row_number() over (partition by least(src, dst), greatest(src, dst) order by id) n from e) select id, src, dst, w from r where n = 1")
def unordered_pairs(spark, d):
    """One edge for each unordered pair, the first by id."""
    return graph.first_by_pair(B.graph_edges(spark, d), "id").select("id", "src", "dst", "w")


@_query(f"""with e as ({_EDGES}), x as (select src node, id o, null i from e union all select dst, null, id from e)
 select node, coalesce(string_agg(o, ' ' order by o), '') outgoing, coalesce(string_agg(i, ' ' order by i), '') incoming from x group by node""")
def adjacency_lists(spark, d):
    """Each node's edges by end, sorted."""
    return graph.adjacency(B.graph_edges(spark, d)).select("node", F.concat_ws(" ", "outgoing").alias("outgoing"), F.concat_ws(" ", "incoming").alias("incoming"))


# -- states and windows ------------------------------------------------------------------------------------------------------------------


_FSM = f"""with recursive f as (select *, row_number() over (partition by user_id order by ts, event_id) pos from ({B.sql('fixes')[1:-1]})),
 d as (select f.user_id, f.pos, p.id place, round({_dist('f', 'p')}, 3) d from f, ({_PLACES}) p),
 c as (select user_id, pos, list(place) filter (d - accuracy <= 45) reach, min({{'d': d, 'p': place}}) near, any_value(event_id) event_id, any_value(accuracy) acc from d join f using (user_id, pos) group by all),
 k as materialized (select user_id, pos, event_id, acc <= 50 ok, coalesce(reach, []) reach, case when near.d + acc <= 30 then near.p end entered from c),
 r(user_id, pos, event_id, status, place, left_place) as (select user_id, 0::bigint, null::bigint, null::varchar, null::bigint, null::bigint from (select distinct user_id from f) union all
  select k.user_id, k.pos, k.event_id, case when not ok then 'uncertain' when coalesce(list_contains(reach, r.place), false) then 'retained' when entered is not null then 'entered' else 'outside' end,
   case when not ok or coalesce(list_contains(reach, r.place), false) then r.place else entered end, case when ok and not coalesce(list_contains(reach, r.place), false) then r.place end
  from r join k on k.user_id = r.user_id and k.pos = r.pos + 1)"""


@_query(_FSM + " select user_id, event_id, status, place, left_place from r where pos > 0")
def proximity_events(spark, d):
    """The proximity state machine over all fixes."""
    return proximity.batch(B.fixes(spark, d), B.places(spark, d))


@_query(_FSM + """, x as (select user_id, event_id, 'exit' event, left_place place, 0 seq from r where left_place is not null union all
 select user_id, event_id, 'enter', place, case when left_place is not null then 1 else 0 end from r where status = 'entered') select user_id, event_id, seq, event, place from x""")
def arrivals(spark, d):
    """Exits and entries, the exit first."""
    return proximity.arrivals(proximity.batch(B.fixes(spark, d), B.places(spark, d)))


_SPOT, _LENGTH = Q.along_line("lat", "lng", B.RING)


@_query(f"""with f as (select *, accuracy <= 50 ok, {_SPOT} s, {_LENGTH} len, {_dist('f', 'e')} away from ({B.sql('fixes')[1:-1]}) f, (select {B.RING[-1][0]}e0 lat, {B.RING[-1][1]}e0 lng) e),
 g as (select *, ok and s.off + accuracy <= 30 i, ok and s.off - accuracy > 45 o from f),
 h as (select *, coalesce(last_value(case when i then true when o then false end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row), false) active from g)
 select user_id, event_id, case when not ok then 'uncertain' when active then case when i then 'on-route' else 'retained' end when o then 'outside' else 'uncertain' end state,
 round(last_value(case when ok and active then s.along end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row), 3) progress_m,
 case when ok and active then round(greatest(len - s.along, 0e0), 3) end remaining_m, case when ok then round(s.off, 3) end off_m, case when ok and active then round(away, 3) end end_m from h""".replace("lat, lng) e)", "lat, lng) e)").replace("select *, accuracy <= 50 ok", "select f.*, accuracy <= 50 ok").replace("radians(lat)", "radians(f.lat)").replace("e0 - lat)", "e0 - f.lat)").replace("e0 - lng)", "e0 - f.lng)"))
def route_progress(spark, d):
    """Progress along a fixed route, by the same hysteresis as for places."""
    return proximity.route_progress(B.fixes(spark, d), B.RING)


@_query("with r as (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) n from events) select user_id, event_id, cast(n as int) n from r where n <= 12")
def trail(spark, d):
    """Each user's last twelve events."""
    by = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(by).alias("n")).filter("n <= 12")


@_query("select time_bucket(interval '1 hour', ts) window_start, event_type, count(*) n, round(sum(value), 2) total from events group by all")
def tumbling_windows(spark, d):
    """Extension: hourly counts and sums."""
    return proximity.tumbling(table(spark, d, "events"), "1 hour")


@_query("""with g as (select user_id, ts, case when ts - lag(ts) over w < interval '30 minutes' then 0 else 1 end new from events window w as (partition by user_id order by ts)),
 s as (select *, sum(new) over (partition by user_id order by ts) s from g) select user_id, min(ts) session_start, count(*) n from s group by user_id, s""")
def session_windows(spark, d):
    """Extension: sessions with a gap of 30 minutes."""
    return proximity.sessions(table(spark, d, "events"), "30 minutes")


from wayfold.plans import contract_queries, discovery_queries, feature_queries, network_queries, raster_file_queries, record_queries, report_queries, source_queries, state_queries, terrain_queries  # noqa: E402, F401
