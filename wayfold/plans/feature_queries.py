"""Map features, links and texts, and layers published as documents with their manifest, gate and phases."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.functions import features as X
from wayfold.functions import geo
from wayfold.operators import contracts, sequences
from wayfold.plans import bindings as B
from wayfold.plans.registry import query
from wayfold.sources import collections, files, layers, publishing
from wayfold.sources.layers import table
from wayfold.sources.scratch import shared_dir


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/scratch/{name}-{uuid.uuid4().hex}"


_SHOWN = ["id", "lat", "lng", "case id % 3 when 0 then 'tree' when 1 then 'visitor' else 'place' end kind", "case id % 5 when 0 then 'bench' when 1 then 'toilet' when 2 then 'picnic' else '' end category"]
#: Trees on a list of allowed ids, and visitor features of the kinds that are switched on.
_WANTED = "kind = 'tree' and id % 2 = 0 or kind = 'visitor' and category in ('bench', 'toilet')"


@query(f"select id, kind, category, lng, lat, true within_bound from (select {', '.join(_SHOWN)} from {B.sql('customers')}) where {_WANTED}")
def feature_collections(spark, d):
    """The wanted points as feature collections by map tile, bounded, written as files and read back."""
    rows = B.customers(spark, d).selectExpr(*_SHOWN).filter(_WANTED)
    x, y = geo.tile_fraction(F.col("lat"), F.col("lng"), F.lit(12))
    props = F.struct(F.col("id").cast("string").alias("id"), "kind", "category")
    feature = rows.select("id", F.floor(x).alias("x"), F.floor(y).alias("y"), X.point_feature(props, F.col("lng"), F.col("lat")).alias("feature"))
    folder = _folder(spark, "features")
    collections.write_collections(feature, folder, ["x", "y"], "id", 40)
    back = collections.read_collections(spark, folder)
    at = F.from_json("coordinates", "array<double>")
    return back.select(F.col("properties")["id"].cast("long").alias("id"), F.col("properties")["kind"].alias("kind"), F.col("properties")["category"].alias("category"), at[0].alias("lng"), at[1].alias("lat"), (F.col("n_features") <= 40).alias("within_bound"))


@query(f"select line, 'LineString' kind, count(*) n_points, arg_min(lng, pos) first_lng, arg_max(lat, pos) last_lat from {B.sql('polylines')} group by line having count(*) >= 2")
def line_features(spark, d):
    """Lines as features, by JSON text and back; lines of fewer than two points have none."""
    lines = B.polylines(spark, d).groupBy("line").agg(F.array_sort(F.collect_list(F.struct("pos", "lng", "lat"))).alias("points"))
    text = lines.select("line", X.line_feature(F.struct(F.col("line").cast("string").alias("id")), F.col("points")).alias("f")).filter("f is not null")
    back = text.select("line", F.from_json("f", "geometry struct<type: string, coordinates: array<array<double>>>").alias("g")).select("line", "g.geometry.*")
    return back.select("line", F.col("type").alias("kind"), F.size("coordinates").cast("long").alias("n_points"), F.col("coordinates")[0][0].alias("first_lng"), F.element_at("coordinates", -1)[1].alias("last_lat"))


_CIRCLE = f"least(greatest(accuracy, 0), {X.MOST_ACCURACY_M})"


@query(f"""select event_id, case when {_CIRCLE} > 0 then 33 end n, case when {_CIRCLE} > 0 then round(lat + degrees({_CIRCLE} / {X.EARTH_M}), 7) end north, case when {_CIRCLE} > 0 then round(lng - degrees({_CIRCLE} / ({X.EARTH_M} * cos(radians(lat)))), 7) end west
 from {B.sql('fixes')}""")
def accuracy_circles(spark, d):
    """The circle that each fix may lie in, of 33 vertices and at most 150 m, by its northernmost and westernmost."""
    rows = B.fixes(spark, d).withColumn("ring", X.accuracy_ring(F.col("lat"), F.col("lng"), F.col("accuracy")))
    most = lambda f, i: F.round(f(F.transform("ring", lambda p: p[i])), 7)
    return rows.select("event_id", F.when(F.col("ring").isNotNull(), F.size("ring")).alias("n"), most(F.array_max, 1).alias("north"), most(F.array_min, 0).alias("west"))


_PROFILE = f"(select \"row\", list(col * 12.5e0 order by col) d, list(z order by col) e from {B.sql('raster')} where z <> -9999 group by 1)"


@query(f"""select "row", array_to_string(list_transform(range(1, len(d) + 1), lambda i: printf('%.1f', round((d[i] - d[1]) / greatest(1, d[-1] - d[1]) * 240, 1)) || ',' || printf('%.1f', round(51 - (e[i] - list_min(e)) / greatest(1, list_max(e) - list_min(e)) * 46, 1))), ' ') points from {_PROFILE}""")
def profile_lines(spark, d):
    """Each row of the elevation grid as a line in a box of 240 x 56, with one decimal."""
    rows = B.shape(spark, d, "raster").filter("z <> -9999").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "z"))).alias("p"))
    distances = F.transform("p", lambda x: x["col"] * F.lit(12.5))
    return rows.select("row", X.profile_points(distances, F.col("p.z")).alias("points"))


_LINK = ["c_custkey id", "case c_custkey % 4 when 0 then 'place' when 1 then 'tree' when 2 then 'feature' else 'road' end kind", "case when c_custkey % 7 <> 0 then concat(c_name, ' /é ü%', c_custkey, '+&=') else '' end target"]
_MADE = "case when kind <> 'road' and target <> '' then concat('#', kind, '=', url_encode(target)) end"


@query(f"select id, {_MADE} link, case when {_MADE} is not null then kind end parsed_kind, case when {_MADE} is not null then target end parsed_id from (select {', '.join(_LINK)} from customer)")
def deep_links(spark, d):
    """Links to places, trees and features, made and read back."""
    rows = table(spark, d, "customer").selectExpr(*_LINK).select("id", X.deep_link(F.col("kind"), F.col("target")).alias("link"))
    return rows.withColumn("p", X.parsed_link(F.col("link"))).select("id", "link", F.col("p.kind").alias("parsed_kind"), F.col("p.id").alias("parsed_id"))


_TEXT = ["p_partkey id", "case when p_partkey % 3 = 0 then 'en' else 'de' end language", "case when p_partkey % 5 <> 0 then p_name end title", "case when p_partkey % 2 = 0 then concat('  <', p_brand, '> & \"', p_type, '\"  ') end description", "case when p_partkey % 3 = 0 then concat(p_name, '''s') when p_partkey % 3 = 1 then '   ' end history"]


@query(f"""select id, replace(replace(replace(replace(replace(coalesce(description, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') html, case language when 'en' then 'en-GB' else 'de-DE' end voice,
 case when trim(coalesce(description, '')) <> '' or trim(coalesce(history, '')) <> '' then concat_ws('. ', nullif(trim(title), ''), nullif(trim(description), ''), nullif(trim(history), '')) end narration from (select {', '.join(_TEXT)} from part)""")
def spoken_texts(spark, d):
    """Texts for a page and for a voice: markup escaped, the voice's tag, and what is read out, empty sections left out."""
    rows = table(spark, d, "part").selectExpr(*_TEXT)
    return rows.select("id", X.escaped_html(F.col("description")).alias("html"), X.speech_tag(F.col("language")).alias("voice"), X.narration(F.col("title"), {"description": F.col("description"), "history": F.col("history")}).alias("narration"))


# -- publishing ----------------------------------------------------------------------------------------------------------------------

_LAYERS = [
    publishing.Layer("nation", "n_nationkey", ("n_nationkey", "n_name", "n_regionkey"), phase="initial"),
    publishing.Layer("supplier", "s_suppkey", ("s_suppkey", "s_name", "s_nationkey"), phase="hydrate"),
    publishing.Layer("part", "p_partkey", ("p_partkey", "p_brand", "p_size"), phase="deferred"),
    publishing.Layer("tree", "id", ("id",), required=False, phase="hydrate"),
]
_TEXTS = {"n_name", "s_name", "p_brand"}
_PER = 300


def _row_sql(x: publishing.Layer) -> str:
    value = lambda c: f"'\"' || {c} || '\"'" if c in _TEXTS else f"cast({c} as varchar)"
    return "'{' || " + " || ',' || ".join(f"'\"{c}\":' || {value(c)}" for c in sorted(x.columns)) + " || '}'"


_DOCUMENTS = "(" + " union all ".join(f"""select '{x.name}' layer, '{x.name}/' || {x.key} // {_PER} || '.json' path, '{{"layer":"{x.name}","rows":[' || string_agg({_row_sql(x)}, ',' order by {x.key}) || '],"schema_version":1}}' doc from {x.name} group by {x.key} // {_PER}""" for x in _LAYERS if x.name != "tree") + ")"


def _published(spark, d) -> str:
    folder = _folder(spark, "published")
    publishing.publish(spark, {x: table(spark, d, x.name) if x.name != "tree" else None for x in _LAYERS}, folder, _PER)
    return folder


@query(f"select path, strlen(doc)::bigint bytes, sha256(doc) sha256 from {_DOCUMENTS}")
def published_documents(spark, d):
    """Layers as canonical documents, each file with its bytes and hash as the manifest has them."""
    return files.manifest(spark, _published(spark, d))


@query(f"select l layer, l <> 'tree' required, phase, count(doc) > 0 available, count(doc) files, coalesce(sum(strlen(doc)), 0)::bigint bytes from (values ('nation', 'initial'), ('supplier', 'hydrate'), ('part', 'deferred'), ('tree', 'hydrate')) n(l, phase) left join {_DOCUMENTS} on layer = l group by all")
def layer_totals(spark, d):
    """Files and bytes of every layer of the contract, and whether it is there."""
    return publishing.layer_sums(files.manifest(spark, _published(spark, d)), _LAYERS)


#: What befalls documents of parts between publishing and the gate, by their number; a stray file and a forbidden one come on top.
_FATE = "case when n % 5 = 1 then 'missing' when n % 5 = 2 then 'bytes' when n % 5 = 3 then 'sha256' else '' end"
_PART_NO = "cast(regexp_extract(path, '([0-9]+)[.]json', 1) as int)"


@query(f"""with f as (select {_FATE} fate, doc from (select *, case when layer = 'part' then {_PART_NO} else 0 end n from {_DOCUMENTS})), g as (select count_if(fate = 'missing') missing, count_if(fate = 'bytes') b, count_if(fate = 'sha256') s from f)
 select u.rule, u.failures::bigint failures, u.failures = 0 ok from (select unnest([{{'rule': 'repeated', 'failures': 0}}, {{'rule': 'missing', 'failures': missing}}, {{'rule': 'unlisted', 'failures': 2}}, {{'rule': 'bytes', 'failures': b}}, {{'rule': 'sha256', 'failures': s}},
 {{'rule': 'outside_contract', 'failures': 1}}, {{'rule': 'forbidden', 'failures': 1}}, {{'rule': 'required_layers', 'failures': 0}}, {{'rule': 'budget', 'failures': 1}}]) u from g)""")
def artifact_checks(spark, d):
    """The gate of a release, some files of which were lost, lengthened or changed after they had been listed, and two of which no one has listed."""
    folder = _published(spark, d)
    found = files.contents(spark, folder).withColumn("n", F.when(F.col("path").startswith("part/"), F.expr(_PART_NO)).otherwise(0)).withColumn("fate", F.expr(_FATE)).filter("fate <> 'missing'")
    flipped = F.concat(F.encode(F.lit("["), "utf-8"), F.expr("substring(content, 2)"))
    content = F.when(F.col("fate") == "bytes", F.concat("content", F.encode(F.lit(" "), "utf-8"))).when(F.col("fate") == "sha256", flipped).otherwise(F.col("content"))
    found = found.select("path", content.alias("content"))
    stray = files.contents(spark, folder).filter("path = 'nation/0.json'").select(F.explode(F.array(F.lit("notes.txt"), F.lit("part/validation.json"))).alias("path"), "content")
    return publishing.gate(files.manifest(spark, folder), found.unionByName(stray), _LAYERS, most_bytes=10, forbidden=("*validation.json",))


@query("select 'hydrate' phase, 'supplier' layer, s_suppkey id, s_name name from supplier union all select 'initial', 'nation', n_nationkey, n_name from nation")
def phased_load(spark, d):
    """The layers of two phases, each read against the manifest and its contract, those of the third left alone."""
    folder = _published(spark, d)
    schema = {"nation": "n_nationkey: bigint, n_name: string, n_regionkey: bigint", "supplier": "s_suppkey: bigint, s_name: string, s_nationkey: bigint", "tree": "id: bigint"}
    parts = [(phase, name, rows) for phase in ("initial", "hydrate") for name, rows in publishing.load(spark, folder, _LAYERS, phase, schema).items() if name != "tree"]
    return reduce(DataFrame.unionByName, (rows.select(F.lit(phase).alias("phase"), F.lit(name).alias("layer"), F.col(f"{name[0]}_{'nation' if name == 'nation' else 'supp'}key").alias("id"), F.col(f"{name[0]}_name").alias("name")) for phase, name, rows in parts))


@query("select 'part' layer, case when count(*) filter (p_size % 2 = 1) > 0 then 'changed' end fault from part having fault is not null union all select 'supplier', 'gone'")
def stale_inputs(spark, d):
    """What a composition was made from against the inputs of now: a layer that has changed and one that is gone."""
    before = publishing.input_set(files.manifest(spark, _published(spark, d)))
    folder = _folder(spark, "published")
    later = table(spark, d, "part").withColumn("p_size", F.expr("p_size - p_size % 2"))
    publishing.publish(spark, {_LAYERS[0]: table(spark, d, "nation"), _LAYERS[2]: later}, folder, _PER)
    return publishing.stale(before, publishing.input_set(files.manifest(spark, folder)))


@query("select 'build' \"origin\", 'nation' layer, n_nationkey id, n_name || '*' \"name\" from nation union all select 'canonical', 'supplier', s_suppkey, s_name from supplier")
def resolved_layers(spark, d):
    """Layers from a build's own folder where it has them, else from the canonical one, by their declared version."""
    build, canonical = _folder(spark, "build"), _folder(spark, "canonical")
    nation, supplier = _LAYERS[0], _LAYERS[1]
    publishing.publish(spark, {nation: table(spark, d, "nation").withColumn("n_name", F.concat("n_name", F.lit("*")))}, build, _PER)
    publishing.publish(spark, {nation: table(spark, d, "nation"), supplier: table(spark, d, "supplier")}, canonical, _PER)
    schema = {"nation": "n_nationkey: bigint, n_name: string, n_regionkey: bigint", "supplier": "s_suppkey: bigint, s_name: string, s_nationkey: bigint"}
    found = publishing.resolved(spark, [build, canonical], [nation, supplier, _LAYERS[3]], schema | {"tree": "id: bigint"})
    row = lambda name, key, text: found[name][1].select(F.lit("build" if found[name][0] == build else "canonical").alias("origin"), F.lit(name).alias("layer"), F.col(key).alias("id"), F.col(text).alias("name"))
    return row("nation", "n_nationkey", "n_name").unionByName(row("supplier", "s_suppkey", "s_name"))


_NAMED = ["c_custkey id", "c_name name", "case c_custkey % 4 when 0 then 'toilet' when 1 then 'bench' when 2 then 'kiosk' end family"]
_FAMILIES = ("toilet", "bench", "kiosk", "shelter")


@query(f"""with p as (select {', '.join(_NAMED)} from customer where c_custkey % 4 <> 3), h as (select *, 200e0 + id % 40 elevation_m from p)
 select 'poi' kind, 'visitor-poi-node-' || id "key", family "value", elevation_m, 'unknown_no_measurement_source' height_status from h
 union all select 'family', f, cast(count(id) as varchar), null, null from (values {", ".join(f"('{f}')" for f in _FAMILIES)}) v(f) left join h on family = f group by f union all select 'total', 'pois', cast(count(*) as varchar), null, null from h""")
def poi_layer(spark, d):
    """A layer of points of interest with their elevations, every one of which must be known, its families counted, absent ones as 0, and their total."""
    points = table(spark, d, "customer").filter("c_custkey % 4 <> 3").selectExpr(*_NAMED)
    elevations = table(spark, d, "customer").selectExpr("c_custkey id", "200e0 + c_custkey % 40 elevation_m")
    pois = contracts.lookup(points, elevations, ["id"], "no elevation", "id")
    none = F.lit(None)
    rows = pois.select(F.lit("poi").alias("kind"), F.concat(F.lit("visitor-poi-node-"), "id").alias("key"), F.col("family").alias("value"), "elevation_m", F.lit("unknown_no_measurement_source").alias("height_status"))
    families = spark.createDataFrame([(f,) for f in _FAMILIES], "key string").join(pois.groupBy(F.col("family").alias("key")).count(), "key", "left")
    families = families.select(F.lit("family").alias("kind"), "key", F.coalesce("count", F.lit(0)).cast("string").alias("value"), none.cast("double").alias("elevation_m"), none.cast("string").alias("height_status"))
    total = pois.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit("total").alias("kind"), F.lit("pois").alias("key"), "value", none.cast("double").alias("elevation_m"), none.cast("string").alias("height_status"))
    return rows.unionByName(families).unionByName(total)


_SAMPLE = ["case user_id % 3 when 0 then 'desktop' when 1 then 'mobile' else 'tablet' end mode", "event_type step", "value ms"]


@query(f"""with s as (select {', '.join(_SAMPLE)} from events), r as (select mode, step, ms, row_number() over (partition by mode, step order by ms) i, count(*) over (partition by mode, step) n from s)
 select mode, step, max(n) samples, min(ms) least, max(ms) most, round(avg(ms), 6) mean, max(case when i = ceil(0.5e0 * n) then ms end) p50, max(case when i = ceil(0.95e0 * n) then ms end) p95 from r group by all""")
def timing_summary(spark, d):
    """What each step of a run took in each mode: number, extremes, mean, and the median and 95th percentile by nearest rank."""
    rows = table(spark, d, "events").selectExpr(*_SAMPLE).select(F.struct("mode", "step").alias("of"), "ms")
    ranks = sequences.nearest_ranks(rows, "of", "ms", {"p50": 0.5, "p95": 0.95})
    return ranks.select("of.*", F.col("n").alias("samples"), F.col("low").alias("least"), F.col("high").alias("most"), F.round("mean", 6).alias("mean"), "p50", "p95")


@query("select n_nationkey id, n_name \"name\", n_regionkey region from nation union all select s_suppkey + 1000, s_name, s_nationkey from supplier")
def pretty_documents(spark, d):
    """A layer as indented JSON documents with a header, one for every 300 rows, written as files and read back as whole documents."""
    rows = table(spark, d, "nation").selectExpr("n_nationkey id", "n_name name", "n_regionkey region").unionByName(table(spark, d, "supplier").selectExpr("s_suppkey + 1000 id", "s_name name", "s_nationkey region"))
    docs = rows.groupBy(F.floor(F.col("id") / _PER).alias("part")).agg(F.array_sort(F.collect_list(F.struct("id", "name", "region"))).alias("rows"))
    text = F.to_json(F.struct(F.lit("1").alias("schema_version"), "rows"), {"pretty": "true"})
    folder = _folder(spark, "pretty")
    files.write_files(docs.select(F.concat(F.col("part").cast("string"), F.lit(".json")).alias("path"), F.encode(F.concat(text, F.lit("\n")), "utf-8").alias("content")), folder)
    row = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("region", T.LongType())])
    return layers.read_document(spark, folder, "rows", row, "1")


_MODULE = r"(?s)export const heights = Object[.]freeze[(](.*?)[)];"


@query(f"select line, pos, round(d, 3) distance_m, case when node % 9 <> 0 then 200e0 + node % 40 end height_m from {B.sql('polylines')}")
def module_maps(spark, d):
    """Nested maps as script modules, a file for every hundred lines, and read back from their text."""
    v = B.polylines(spark, d).selectExpr("line", "pos", "round(d, 3) d", "case when node % 9 <> 0 then 200e0 + node % 40 end z")
    lines = v.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("pos", "d", "z"))).alias("p"))
    value = F.struct(F.col("p.d").alias("distances"), F.col("p.z").alias("heights"), F.col("p.pos").alias("places"))
    modules = lines.groupBy(F.floor(F.col("line") / 100).alias("part")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("line").cast("string").alias("k"), value.alias("v"))))).alias("m"))
    text = F.concat(F.lit("// Made by a query. Do not edit by hand.\nexport const heights = Object.freeze("), F.to_json("m", {"ignoreNullFields": "false"}), F.lit(");\n"))
    folder = _folder(spark, "modules")
    files.write_files(modules.select(F.concat(F.col("part").cast("string"), F.lit(".mjs")).alias("path"), F.encode(text, "utf-8").alias("content")), folder)
    body = F.regexp_extract(F.decode("content", "utf-8"), _MODULE, 1)
    back = files.read_files(spark, folder).select(F.explode(F.from_json(body, "map<string, struct<distances: array<double>, heights: array<double>, places: array<bigint>>>", {"mode": "FAILFAST"})).alias("line", "v"))
    each = back.select(F.col("line").cast("long").alias("line"), F.explode(F.arrays_zip("v.places", "v.distances", "v.heights")).alias("x"))
    return each.select("line", F.col("x.places").alias("pos"), F.col("x.distances").alias("distance_m"), F.col("x.heights").alias("height_m"))


@query(f"select 10 * sum(length(points) + n)::bigint checksum, 10 * count(*) profiles from (select points, (select count(*) from {B.sql('raster')} g where g.row = q.\"row\" and g.z <> -9999) n from (select \"row\", array_to_string(list_transform(range(1, len(d) + 1), lambda i: printf('%.1f', round((d[i] - d[1]) / greatest(1, d[-1] - d[1]) * 240, 1)) || ',' || printf('%.1f', round(51 - (e[i] - list_min(e)) / greatest(1, list_max(e) - list_min(e)) * 46, 1))), ' ') points from {_PROFILE}) q)")
def profile_batch(spark, d):
    """Every profile made into a line, ten times over, with a checksum that shows that none was left out."""
    rows = B.shape(spark, d, "raster").filter("z <> -9999").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "z"))).alias("p"))
    points = X.profile_points(F.transform("p", lambda x: x["col"] * F.lit(12.5)), F.col("p.z"))
    each = rows.select(F.explode(F.sequence(F.lit(1), F.lit(10))).alias("again"), points.alias("points"), F.size("p").alias("n"))
    return each.agg(F.sum(F.length("points") + F.col("n")).alias("checksum"), F.count(F.lit(1)).alias("profiles"))
