"""Sources and sinks: what the driver's tables hold is written as documents, tiles and lists, and read back strictly."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.functions import geo, records
from wayfold.operators import contracts
from wayfold.plans import bindings as B
from wayfold.plans.registry import query
from wayfold.sources import layers, lookups, wiki
from wayfold.sources.layers import table
from wayfold.sources.scratch import shared_dir

_Z = "case when id % 11 <> 0 then 200e0 + id % 40 end"


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/scratch/{name}-{uuid.uuid4().hex}"


@query(f"select cast(round(lat * 1e7) as bigint) lat7, cast(round(lng * 1e7) as bigint) lng7, {_Z} elevation from {B.sql('customers')}")
def layer_documents(spark, d):
    """Points as JSON documents with a version in their header, read back by their schema, keyed by coordinates."""
    points = B.customers(spark, d).selectExpr("id", "lat", "lng", f"{_Z} elevation")
    # a document for every thousand points
    docs = points.groupBy(F.floor(F.col("id") / 1000).alias("part")).agg(F.collect_list(F.struct("lat", "lng", "elevation")).alias("points"))
    path = _folder(spark, "points")
    docs.select(F.to_json(F.struct(F.lit("2").alias("schema_version"), "points"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    rows = layers.read_document(spark, path, "points", layers.POINT, "2", lines=True)
    lat, lng = geo.coordinate_key(F.col("lat"), F.col("lng"))
    return rows.select(lat.alias("lat7"), lng.alias("lng7"), "elevation")


_ELEMENT = T.StructType([T.StructField("type", T.StringType()), T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("rev", T.LongType())])


@query("select case when s_suppkey % 2 = 0 then 'node' else 'way' end as type, s_suppkey // 4 as id, max(s_suppkey) rev, arg_max(s_name, s_suppkey) as name from supplier group by all")
def source_elements(spark, d):
    """Elements of JSON documents by type and id, the last of several."""
    s = table(spark, d, "supplier").selectExpr("case when s_suppkey % 2 = 0 then 'node' else 'way' end type", "s_suppkey div 4 id", "s_name name", "s_suppkey rev")
    path = _folder(spark, "elements")
    # documents by range of revision, so that later ones stand in later files
    docs = s.groupBy(F.floor(F.col("rev") / 500).alias("part")).agg(F.array_sort(F.collect_list(F.struct("rev", "type", "id", "name"))).alias("elements"))
    docs.select("part", F.to_json(F.struct("elements")).alias("value")).repartitionByRange("part").sortWithinPartitions("part").select("value").write.text(path)
    return layers.read_elements(spark, path, _ELEMENT).select("type", "id", "name", "rev")


_NODE = ["c_custkey id", "case c_custkey % 5 when 0 then 'bench' when 1 then 'toilets' end amenity", "1 + c_custkey % 12 version"]


def _tiles(spark, d, *, own_tags: bool = False) -> str:
    """Nodes and ways as XML in four tiles; every seventh element stands in two of them, once with an older version and fewer tags."""
    c = B.customers(spark, d).join(table(spark, d, "customer").selectExpr(*_NODE), "id")
    n = table(spark, d, "customer").count()
    twice = F.explode(F.array_compact(F.array(F.lit(0), F.when(F.col("id") % 7 == 0, 1))))
    c = c.withColumn("again", twice)
    tag = lambda k, v: F.when(v.isNotNull(), F.concat(F.lit(f'<tag k="{k}" v="'), v, F.lit('"/>')))
    version = (F.col("version") - F.col("again")).cast("string")
    node = F.concat(F.lit('<node id="'), F.col("id").cast("string"), F.lit('" lat="'), F.format_string("%.7f", "lat"), F.lit('" lon="'), F.format_string("%.7f", "lng"), F.lit('" version="'), version, F.lit('" timestamp="2024-01-0'), (1 + F.col("id") % 9).cast("string"), F.lit('">'), F.concat_ws("", tag("amenity", F.col("amenity")), F.when(F.col("again") == 0, tag("tile", F.lit("own")))), F.lit("</node>"))
    place = (((F.col("id") + F.col("again")) % 4).alias("tile"), F.floor(F.col("id") / 4000).alias("part"))
    nodes = c.select(*place, node.alias("value"))
    refs = B.polylines(spark, d).groupBy(F.col("line").alias("id")).agg(F.array_sort(F.collect_list(F.struct("pos", (F.col("node") % (n + n // 10)).alias("ref")))).alias("r"))
    nd = F.array_join(F.transform("r", lambda x: F.concat(F.lit('<nd ref="'), x["ref"].cast("string"), F.lit('"/>'))), "")
    way = F.concat(F.lit('<way id="'), F.col("id").cast("string"), F.lit('" version="'), (1 + F.col("id") % 3).cast("string"), F.lit('">'), nd, tag("highway", F.when(F.col("id") % 3 == 0, "steps").otherwise("path")), F.when(F.lit(own_tags) & (F.col("again") == 1), tag("note", F.lit("again"))).otherwise(""), F.lit("</way>"))
    ways = refs.withColumn("again", twice).select(*place, way.alias("value"))
    bounds = F.format_string('<bounds minlat="%.1f" minlon="%.1f" maxlat="%.1f" maxlon="%.1f"/>', F.col("tile") / 10 + 51, F.col("part") / 10 + 9, F.col("tile") / 10 + 51.1, F.col("part") / 10 + 9.1)
    path = _folder(spark, "tiles")
    # a file is one document of a bounded number of elements
    docs = nodes.unionByName(ways).groupBy("tile", "part").agg(F.concat(F.lit("<osm>"), bounds, F.array_join(F.collect_list("value"), ""), F.lit("</osm>")).alias("value"))
    docs.write.partitionBy("tile", "part").text(path)
    return path


@query(f"select cast(id as varchar) id, lat, lng, cast(version as bigint) as version, concat_ws(' ', 'amenity=' || amenity, 'tile=own') tags, case when id % 7 = 0 then 2 else 1 end tiles from {B.sql('customers')} p join (select {', '.join(_NODE)} from customer) c using (id)")
def tile_nodes(spark, d):
    """Nodes of several XML tiles as one: places must agree, versions compare as numbers, tags are merged."""
    n = layers.reconciled_nodes(spark, _tiles(spark, d))
    tags = F.concat_ws(" ", F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return n.select("id", "lat", "lng", "version", tags.alias("tags"), F.size("tiles").alias("tiles"))


@query(f"""with r as (select line, pos, node % (select count(*) + count(*) // 10 from customer) ref from {B.sql('polylines')}) select cast(line as varchar) id, count(*) n_refs, string_agg(cast(ref as varchar), ' ' order by pos) refs, case when line % 3 = 0 then 'steps' else 'path' end highway,
 case when line % 7 = 0 then 2 else 1 end::bigint n_tiles, count(distinct case when ref not in (select c_custkey from customer) then ref end) missing from r group by line""")
def tile_ways(spark, d):
    """Ways of several tiles as one, with the nodes that no tile holds."""
    path = _tiles(spark, d)
    w = layers.reconciled_ways(spark, path, layers.reconciled_nodes(spark, path))
    return w.select("id", F.size("refs").cast("long").alias("n_refs"), F.array_join("refs", " ").alias("refs"), F.col("tags")["highway"].alias("highway"), "n_tiles", F.size("missing_refs").cast("long").alias("missing"))


#: A tile's number and part, by its folder.
_TILE_NAME = "tile=([0-9]+)/part=([0-9]+)"
_TILE_SET = f"(select distinct (id + again) % 4 tile, id // 4000 part from (select c_custkey id from customer union select line from {B.sql('polylines')}), (values (0), (1)) a(again) where again = 0 or id % 7 = 0)"


@query(f"select tile || '/' || part as \"name\", (tile / 10e0 + 51)::decimal(9, 1)::double south, (part / 10e0 + 9)::decimal(9, 1)::double west, (tile / 10e0 + 51.1e0)::decimal(9, 1)::double north, (part / 10e0 + 9.1e0)::decimal(9, 1)::double east, true hashed from {_TILE_SET}")
def tile_set(spark, d):
    """Exactly the expected tiles, each with its bounds as they were, and its hash."""
    name = F.concat_ws("/", *(F.regexp_extract("file", _TILE_NAME, i) for i in (1, 2)))
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("id")).union(B.polylines(spark, d).select("line")).distinct()
    tiles = ids.select("id", F.explode(F.array_compact(F.array(F.lit(0), F.when(F.col("id") % 7 == 0, 1)))).alias("again")).select(((F.col("id") + F.col("again")) % 4).alias("t"), F.floor(F.col("id") / 4000).alias("p")).distinct()
    edge = lambda c, base: F.round(F.col(c) / 10 + base, 1)
    expected = tiles.select(F.concat_ws("/", "t", "p").alias("name"), edge("t", 51).alias("south"), edge("p", 9).alias("west"), edge("t", 51.1).alias("north"), edge("p", 9.1).alias("east"))
    rows = layers.exact_tiles(spark, f"{_tiles(spark, d)}/*/*/*", expected, name)
    return rows.select("name", "south", "west", "north", "east", (F.length("sha256") == 64).alias("hashed"))


@query(f"select cast(line as varchar) id, case when line % 7 = 0 then 'again' end note, case when line % 3 = 0 then 'steps' else 'path' end highway, count(*) n_refs from {B.sql('polylines')} group by line")
def merged_tile_ways(spark, d):
    """Ways of several tiles whose tags differ, merged; only their nodes must agree."""
    path = _tiles(spark, d, own_tags=True)
    ways = layers.reconciled_ways(spark, path, layers.reconciled_nodes(spark, path), merge_tags=True)
    return ways.select("id", F.col("tags")["note"].alias("note"), F.col("tags")["highway"].alias("highway"), F.size("refs").cast("long").alias("n_refs"))


@query(f"""with n as materialized (select id, cast(round(lat * 1e7) as bigint) lat7, cast(round(lng * 1e7) as bigint) lng7 from {B.sql('customers')}), r as (select line, node % (select count(*) + count(*) // 10 from customer) a, lead(node % (select count(*) + count(*) // 10 from customer)) over (partition by line order by pos) b from {B.sql('polylines')}),
 p as (select line, a.lat7, a.lng7, b.lat7 to_lat7, b.lng7 to_lng7 from r join n a on a.id = r.a join n b on b.id = r.b)
 select lat7, lng7, to_lat7, to_lng7, count(*) n, count(distinct way) ways, count_if(direction = 'forward') forwards from (select *, line way, 'forward' direction from p union all select line, to_lat7, to_lng7, lat7, lng7, line, 'reverse' from p) group by all""")
def tile_adjacency(spark, d):
    """Which ways lead from where to where, in both directions, from the tiles' nodes and ways."""
    path = _tiles(spark, d)
    pairs = layers.adjacency(layers.reconciled_nodes(spark, path), layers.read_ways(spark, path))
    return pairs.groupBy("lat7", "lng7", "to_lat7", "to_lng7").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("way").alias("ways"), F.count_if(F.col("direction") == "forward").alias("forwards"))


@query(f"select cast(id as varchar) id, 200e0 + id % 40 elevation_m, 'bench' amenity from (select {', '.join(_NODE)} from customer) where amenity = 'bench' and id % 11 <> 0")
def wanted_benches(spark, d):
    """The benches among the tiles' nodes that an id list names, every one of which must be there, with their elevations."""
    ids = table(spark, d, "customer").filter("c_custkey % 5 = 0 and c_custkey % 11 <> 0").select(F.col("c_custkey").cast("string").alias("value"))
    path = _folder(spark, "ids")
    ids.write.text(path)
    listed = layers.read_ids(spark, path, expected=ids.count())
    benches = layers.reconciled_nodes(spark, _tiles(spark, d)).filter(F.col("tags")["amenity"] == "bench")
    chosen = layers.wanted(benches, listed).join(listed, "id", "left_semi")
    elevations = B.customers(spark, d).selectExpr("cast(id as string) id", f"{_Z} elevation_m").filter("elevation_m is not null")
    return contracts.lookup(chosen, elevations, ["id"], "no elevation for", "id").select("id", "elevation_m", F.col("tags")["amenity"].alias("amenity"))


@query("select p_partkey id, concat('{\"p_brand\":\"', p_brand, '\",\"p_partkey\":', p_partkey, ',\"p_size\":', case when p_size % 4 = 0 then 'null' else cast(p_size as varchar) end, '}') json from part")
def canonical_rows(spark, d):
    """Rows as JSON with fields by name and nulls written, read back from the file."""
    p = table(spark, d, "part").selectExpr("p_partkey", "p_brand", "case when p_size % 4 <> 0 then p_size end p_size")
    path = _folder(spark, "rows")
    p.select(layers.canonical_json(["p_size", "p_partkey", "p_brand"]).alias("value")).write.text(path)
    back = spark.read.text(path)
    return back.select(F.get_json_object("value", "$.p_partkey").cast("long").alias("id"), F.col("value").alias("json"))


_PUBLISHED = {"region": ["r_regionkey", "r_name"], "supplier": ["s_suppkey", "s_name", "s_nationkey"]}


def _hash(layer: str) -> str:
    text = " || ".join(f"coalesce(concat(length(cast({c} as varchar)), ':', cast({c} as varchar)), '-')" for c in sorted(_PUBLISHED[layer]))
    sums = ", ".join(f"coalesce(cast(sum(('0x' || substr(h, {a}, 8))::bigint) as varchar), '0')" for a in (1, 9, 17, 25))
    return f"select '{layer}' layer, count(*) n_rows, sha256(concat_ws('-', count(*), {sums})) content_hash from (select sha256({text}) h from {layer})"


@query(" union all ".join(_hash(x) for x in _PUBLISHED))
def published_layers(spark, d):
    """Layers written and described by a manifest of what was read back: rows and content hash."""
    return layers.write_layers({n: table(spark, d, n).select(*c) for n, c in _PUBLISHED.items()}, _folder(spark, "published"))


@query("with h as (" + " union all ".join(_hash(x) for x in _PUBLISHED) + ") select sha256(string_agg(layer || ':' || content_hash, chr(10) order by layer)) input_set, sum(n_rows)::bigint n_rows, (select max(cast(o_orderdate as varchar)) from orders) generated_at from h")
def composition_header(spark, d):
    """The header of a composition: a digest over its layers' hashes, their rows, and the latest of their time stamps."""
    hashes = None
    for n, c in _PUBLISHED.items():
        one = layers.content_hash(table(spark, d, n).select(*c), n)
        hashes = one if hashes is None else hashes.unionByName(one)
    # a row for each layer
    lines = F.transform(F.array_sort(F.collect_list(F.struct("layer", "content_hash"))), lambda x: F.concat(x["layer"], F.lit(":"), x["content_hash"]))
    head = hashes.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("input_set"), F.sum("n_rows").alias("n_rows"), F.lit(1).alias("_one"))
    latest = table(spark, d, "orders").agg(F.max(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("generated_at"), F.lit(1).alias("_one"))
    return head.join(F.broadcast(latest), "_one").drop("_one")


_FEATURE = ["id", "case id % 4 when 0 then concat('Name ', id) when 1 then '' end name", "case id % 9 when 0 then 'bench' when 1 then 'drinking_water' when 2 then 'picnic_site' when 3 then null else 'toilet' end kind", "case when id % 5 <> 0 then cast(id as varchar(9)) end source_id"]
_LABEL = "case kind when 'bench' then 'Benches' when 'drinking_water' then 'Drinking water' when 'toilet' then 'Toilets' else replace(coalesce(kind, 'visitor_poi'), '_', ' ') end"


@query(f"select id, coalesce(nullif(name, ''), concat_ws(' · ', {_LABEL}, source_id)) label from (select {', '.join(_FEATURE)} from {B.sql('customers')})")
def feature_labels(spark, d):
    """What a visitor feature is called: its name, else its family in words with its source's id."""
    f = B.customers(spark, d).selectExpr(*(c.replace("varchar(9)", "string") for c in _FEATURE))
    return f.select("id", records.feature_label(F.col("name"), records.family_label(F.col("kind")), F.col("source_id")).alias("label"))


@query("""select n_name layer, count(c_custkey) n, case when count(c_custkey) = 0 then 'pending' when contains(lower(any_value(said)), 'complete') or contains(lower(any_value(said)), 'ready') then 'ready' else 'partial' end state from (select *, case n_nationkey % 3 when 0 then 'Complete 2024' when 1 then 'READY' else 'draft' end said from nation)
 left join (select * from customer where c_nationkey % 5 <> 0) on c_nationkey = n_nationkey group by n_name""")
def dataset_states(spark, d):
    """The state of each dataset by its rows and what it says of itself, those without rows included."""
    n = table(spark, d, "nation").withColumn("said", F.when(F.col("n_nationkey") % 3 == 0, "Complete 2024").when(F.col("n_nationkey") % 3 == 1, "READY").otherwise("draft"))
    c = table(spark, d, "customer").filter("c_nationkey % 5 <> 0").select("c_nationkey", "c_custkey")
    g = n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_name").alias("layer")).agg(F.count("c_custkey").alias("n"), F.max("said").alias("said"))
    return g.select("layer", "n", records.dataset_state(F.col("n"), F.col("said")).alias("state"))


@query(f"select a.id, b.z - a.z rise_m, coalesce(b.z - a.z >= 20, false) ok from (select e.id, src, dst from {B.EDGES} e) a0 join (select e.id, n.z from {B.EDGES} e join (select node, case when node % 9 <> 0 then z end z from {B.sql('nodes')}) n on n.node = src) a using (id) join (select e.id, n.z from {B.EDGES} e join {B.sql('nodes')} n on n.node = dst) b using (id)")
def rise_controls(spark, d):
    """Climbs between two ends, and whether they are as large as they should be; an unknown one isn't."""
    n = B.shape(spark, d, "nodes")
    low = n.select(F.col("node").alias("src"), F.when(F.col("node") % 9 != 0, F.col("z")).alias("low"))
    j = B.graph_edges(spark, d).join(low, "src").join(n.select(F.col("node").alias("dst"), F.col("z").alias("high")), "dst")
    r = geo.rise_is_sane(F.col("low"), F.col("high"), 20.0)
    return j.select("id", r["rise_m"].alias("rise_m"), r["ok"].alias("ok"))


@query(f"with v as (select line, list(node order by pos) n from {B.sql('polylines')} group by line) select line, n[cast(floor((len(n) - 1) / 2) as int) + 1] middle, n[1] = n[len(n)] and len(n) >= 4 closed, array_to_string(case when n[1] = n[len(n)] then n else list_append(n, n[1]) end, ' ') ring from v")
def rings(spark, d):
    """Each line's middle vertex, whether it is a ring, and the ring that it makes when closed."""
    v = B.polylines(spark, d).groupBy("line").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("n"))
    first, last = F.get("n", F.lit(0)), F.element_at("n", -1)
    ring = F.when(first == last, F.col("n")).otherwise(F.concat("n", F.array(first)))
    return v.select("line", records.middle_vertex(F.col("n")).alias("middle"), ((first == last) & (F.size("n") >= 4)).alias("closed"), F.array_join(F.transform(ring, lambda x: x.cast("string")), " ").alias("ring"))


@query(f"with p as (select line, node a, lead(node) over (partition by line order by pos) b from {B.sql('polylines')}), e as (select src, dst, min(id) id, count(*) n from {B.EDGES} where id not like 'c%' group by all) select line, a, b, e.id edge, n candidates from p join e on e.src = a and e.dst = b")
def edge_lookups(spark, d):
    """For pairs of nodes next to each other on a line the first edge between them, and how many there are, of the families that count."""
    v = B.polylines(spark, d).select("line", F.col("node").alias("a"), F.lead("node").over(W.partitionBy("line").orderBy("pos")).alias("b"))
    e = B.graph_edges(spark, d).filter(~F.startswith("id", F.lit("c"))).groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.min("id").alias("edge"), F.count(F.lit(1)).alias("candidates"))
    return v.join(e, ["a", "b"]).select("line", "a", "b", "edge", "candidates")



class Heights:
    """A service that knows a height for every place, but is busy when it is first asked; it travels to the tasks with the plan."""

    def __init__(self):
        self.heard = set()

    def __call__(self, places):
        if places[0] not in self.heard:
            self.heard.add(places[0])
            raise lookups.StatusError(503)
        return [200.0 + (round(lat * 1e7) + 3 * round(lng * 1e7)) % 4000 / 10 for lat, lng in places]


_HEIGHT = "200e0 + (cast(round(lat * 1e7) as bigint) + 3 * cast(round(lng * 1e7) as bigint)) % 4000 / 10e0"
_KNOWN = {"trees": "id % 3 = 0", "benches": "id % 5 = 0", "paths": "id % 7 = 0"}


@query(f"""with p as (select id, {_HEIGHT} as "value", lat, lng, case {" ".join(f"when {c} then {i}" for i, c in enumerate(_KNOWN.values()))} end know from {B.sql('customers')}), k as (select lat, lng, min(know) know from p group by all)
 select id, p."value", case when k.know is null then 'fetched' else 'reused' end "source", case k.know {" ".join(f"when {i} then '{n}'" for i, n in enumerate(_KNOWN))} end layer from p join k using (lat, lng)""")
def selected_heights(spark, d):
    """Heights of a selection of places: those that three earlier layers know are taken from them, others asked for in batches, with a journal, again where
    the service was busy."""
    places = B.customers(spark, d).select("id", "lat", "lng")
    known = {name: places.filter(c).selectExpr("lat", "lng", f"{_HEIGHT} value") for name, c in _KNOWN.items()}
    rows = lookups.lookup(places, Heights(), _folder(spark, "journal"), known=known, delay=0.01, again=lookups.passing)
    return rows.select("id", "value", "source", F.when(F.col("source") == "reused", F.col("origin")).alias("layer"))


#: Forty parts a page: a header, then a row of a number, a link and a size for each part, the size of every sixth over two columns.
_WIKI_ROW = "concat('|-\\n| ', p_partkey, case when p_partkey % 2 = 0 then ' || ' else '\\n| ' end, '[[Part/', p_partkey, '|''''''', p_name, ''''''']]', case when p_partkey % 6 = 0 then ' || colspan=\"2\" | ' else ' || ' end, p_size, case when p_partkey % 6 = 0 then '' else ' || {{unit|cm|x=1}}' end)"


@query("""with p as (select p_partkey // 40 page, row_number() over (partition by p_partkey // 40 order by p_partkey) r, * from part),
 c as (select page, r, 0 c, p_partkey::varchar said, null target, false spanned from p union all select page, r, 1, p_name, 'Part/' || p_partkey, false from p union all select page, r, 2, p_size::varchar, null, false from p
  union all select page, r, 3, case when p_partkey % 6 = 0 then p_size::varchar else 'cm' end, null, p_partkey % 6 = 0 from p union all select distinct page, 0, i, h, null, false from p, (values (0, 'Number'), (1, 'Name'), (2, 'Size'), (3, 'Unit')) h(i, h))
 select 'page ' || page page, r::int "row", c::int col, r = 0 header, said, target, spanned from c""")
def wiki_cells(spark, d):
    """Tables in wiki markup, cell by cell, with links, emphasis, templates and spans read."""
    rows = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 40).cast("long").alias("page"), "p_partkey", F.expr(_WIKI_ROW).alias("line"))
    pages = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))).alias("lines"))
    head = 'Some text.\n{| class="wikitable"\n|+ Parts\n! Number !! Name\n! style="x" | Size !! Unit\n'
    text = F.concat(F.lit(head), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n|}\nMore text."))
    cells = wiki.cells(pages.select(F.concat(F.lit("page "), F.col("page").cast("string")).alias("page"), text.alias("text")))
    return cells.select("page", "row", "col", "header", F.col("text").alias("said"), "target", "spanned")


@query(f"select id, case when id % 2 = 0 then 'tree' else 'bench' end kind, {_HEIGHT} as \"value\" from {B.sql('customers')}")
def tree_bench_heights(spark, d):
    """Heights of trees and of benches, each selection with a journal of its own."""
    places = B.customers(spark, d).select("id", "lat", "lng")
    ask = lambda kind, left: lookups.lookup(places.filter(F.col("id") % 2 == left), Heights(), _folder(spark, kind), delay=0.01, again=lookups.passing).select("id", F.lit(kind).alias("kind"), "value")
    return ask("tree", 0).unionByName(ask("bench", 1))
