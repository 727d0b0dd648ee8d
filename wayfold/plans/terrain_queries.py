"""Projections, elevation grids, tiles and profiles along lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import contracts, raster, sequences, spatial
from wayfold.plans import bindings as B
from wayfold.plans import sqltext as Q
from wayfold.plans.registry import query

_COLUMNS = 50
#: Where the grid lies: cells from its west and north edge, for points with lat and lng.
_X = "(lng - 9.385e0) / 0.04e0 * 50"
_Y = "(51.323e0 - lat) / 0.016e0 * {rows}"
_ROWS = "(select cast(ceil(count(*) / 50e0) as int) from part)"
_GRID = B.sql("raster")
_AT = f"(select id, {_X} x, {_Y.format(rows=_ROWS)} y from {B.sql('customers')})"


def _rows(spark, d) -> int:
    return -(-B.n_nodes(spark, d) // _COLUMNS)


def _points(spark, d) -> DataFrame:
    return B.customers(spark, d).selectExpr("id", f"{_X} x", f"{_Y.format(rows=_rows(spark, d))} y")


@query(f"select id, case when z <> -9999 then z end z from {_AT} p left join {_GRID} g on g.row = floor(p.y) and g.col = floor(p.x) and p.x >= 0 and p.x < 50 and p.y >= 0 and p.y < {_ROWS}")
def raster_nearest(spark, d):
    """The elevation of the grid cell that each point lies in."""
    return raster.nearest(_points(spark, d), B.shape(spark, d, "raster"), _COLUMNS, _rows(spark, d)).select("id", "z")


def _bilinear_sql(points: str, key: str, clamp: bool) -> str:
    inside = "true" if clamp else f"x between 0 and 50 and y between 0 and {_ROWS}"
    return f"""select {key}, case when bool_and(z is not null or share = 0) then sum(coalesce(z * share, 0)) end z from (select {key}, least(floor(n) + i, {_ROWS} - 1) r, least(floor(e) + j, 49) c, case when i = 1 then n - floor(n) else 1 - n + floor(n) end * case when j = 1 then e - floor(e) else 1 - e + floor(e) end share
 from (select {key}, case when {inside} then least(greatest(x - 0.5, 0), 49)::double end e, case when {inside} then least(greatest(y - 0.5, 0), {_ROWS} - 1)::double end n from {points}), (values (0), (1)) a(i), (values (0), (1)) b(j)) left join {_GRID} g on g.row = r and g.col = c group by {key}"""


@query(f"select id, round(z, 6) z from ({_bilinear_sql(_AT, 'id', False)})")
def dem_sample(spark, d):
    """Bilinear samples of an elevation grid, null where it doesn't reach."""
    return raster.bilinear(_points(spark, d), B.shape(spark, d, "raster"), _COLUMNS, _rows(spark, d), key=["id"], clamp=False).select("id", F.round("z", 6).alias("z"))


@query(f"select count(*) n, min(z) filter (z <> -9999) low, max(z) filter (z <> -9999) high, count_if(z = -9999) n_nodata, bool_and(isfinite(z)) all_finite from {_GRID}")
def raster_statistics(spark, d):
    """What a grid must show before it is published."""
    return raster.statistics(B.shape(spark, d, "raster"))


@query(f"select a.row, a.col, a.z one, case when a.z > 300 then a.z + 1 else a.z end other from {_GRID} a where a.z > 300 and a.row % 2 = 0 union all select row, col, z, null from {_GRID} where row % 2 = 1 and col = 7")
def raster_differences(spark, d):
    """Cells in which a published grid isn't its source."""
    grid = B.shape(spark, d, "raster")
    other = grid.filter("not (row % 2 = 1 and col = 7)").withColumn("z", F.expr("case when z > 300 and row % 2 = 0 then z + 1 else z end"))
    return raster.differences(grid, other)


@query(f"select id, round(lat, 8) lat, round(lng, 8) lng, true near from {B.sql('customers')}")
def utm_roundtrip(spark, d):
    """Zone 32 and back, within two centimetres."""
    p = B.customers(spark, d)
    east, north = geo.utm32(F.col("lat"), F.col("lng"))
    p = p.withColumn("e", east).withColumn("n", north)
    lat, lng = geo.utm32_inverse(F.col("e"), F.col("n"))
    p = p.withColumn("lat2", lat).withColumn("lng2", lng)
    return p.select("id", F.round("lat2", 8).alias("lat"), F.round("lng2", 8).alias("lng"), (geo.haversine_atan2(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")) < 0.02).alias("near"))


_BOXES = f"(select nation, min(lat) south, min(lng) west, max(lat) north, max(lng) east from (select c_nationkey nation, lat, lng from {B.sql('customers')} p join customer on c_custkey = p.id) group by nation)"


def _boxes(spark, d) -> DataFrame:
    nation = B.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    return spatial.bounds(B.customers(spark, d).join(nation, "id"), "nation")


def _corner_sql(x: str, y: str) -> tuple[str, str]:
    return Q.krueger(y, x)


_CORNERS = [_corner_sql(x, y) for y in ("south", "north") for x in ("west", "east")]
_LOW = lambda i: "least(" + ", ".join(c[i] for c in _CORNERS) + ")"
_HIGH = lambda i: "greatest(" + ", ".join(c[i] for c in _CORNERS) + ")"
_AREA = f"(select nation, cast(floor({_LOW(0)} - 150) as bigint) w, cast(floor({_LOW(1)} - 150) as bigint) s, cast(ceil({_HIGH(0)} + 150) as bigint) e, cast(ceil({_HIGH(1)} + 150) as bigint) n from {_BOXES})"


@query(f"select nation, w west, s south, e east, n north, (e - w) * (n - s) cells from {_AREA}")
def areas_of_interest(spark, d):
    """The projected box around each nation's customers, with a margin and a cap on its cells."""
    return raster.area_of_interest(_boxes(spark, d), "nation")


@query(f"select nation, true inside from {_AREA}")
def area_bounds(spark, d):
    """A projected box's bounds in degrees hold the box that it was made from."""
    boxes = _boxes(spark, d)
    area = raster.area_of_interest(boxes, "nation")
    corners = geo.box_corners(F.col("west"), F.col("south"), F.col("east"), F.col("north"), lambda y, x: geo.utm32_inverse(x, y))
    back = area.withColumn("c", corners).select("nation", F.array_min("c.x").alias("s"), F.array_max("c.x").alias("n"), F.array_min("c.y").alias("w"), F.array_max("c.y").alias("e"))
    return back.join(boxes, "nation").select("nation", F.expr("s < south and n > north and w < west and e > east").alias("inside"))


_TILE = lambda lat, lng: (f"({lng} + 180) / 360 * pow(2, zoom)", f"(1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * pow(2, zoom)")
_RANGES = f"""(select *, (x_max - x_min + 1) * (y_max - y_min + 1) tiles from (select nation, zoom, cast(floor({_TILE('south', 'west')[0]}) as bigint) x_min, cast(ceil({_TILE('north', 'east')[0]}) - 1 as bigint) x_max,
 cast(floor({_TILE('north', 'east')[1]}) as bigint) y_min, cast(ceil({_TILE('south', 'west')[1]}) - 1 as bigint) y_max from {_BOXES}, (values (13), (14), (15), (16)) z(zoom)))"""


@query(f"select nation, zoom, x_min, x_max, y_min, y_max, tiles from {_RANGES}")
def tile_counts(spark, d):
    """The tiles that each nation's customers take at four zooms."""
    return raster.tile_ranges(_boxes(spark, d), [13, 14, 15, 16]).select("nation", "zoom", "x_min", "x_max", "y_min", "y_max", "tiles")


_PIXEL = f"""(select zoom, x, y, r "row", c "column", degrees(atan(sinh(pi() * (1 - 2 * ((y + (r + 0.5e0) / 8) / pow(2, zoom)))))) lat, (x + (c + 0.5e0) / 8) / pow(2, zoom) * 360 - 180 lng
 from (select distinct zoom, x, unnest(range(y_min, y_max + 1)) y from (select zoom, unnest(range(x_min, x_max + 1)) x, y_min, y_max from {_RANGES} where zoom = 14)), range(8) a(r), range(8) b(c))"""
_PIXEL_AT = f'(select zoom, x, y, "row", "column", {_X} px, {_Y.format(rows=_ROWS)} py from {_PIXEL})'
_PIXEL_Z = _bilinear_sql(f'(select zoom, x tx, y ty, "row" pr, "column" pc, px x, py y from {_PIXEL_AT})', "zoom, tx, ty, pr, pc", True)


@query(f"""with z as materialized (select *, cast(round_even((round(z, 3) + 32768) * 256, 0) as bigint) q from ({_PIXEL_Z}))
 select zoom, tx x, ty y, count(*) n_pixels, sha256(unhex(string_agg(printf('%06X', q), '' order by pr, pc))) sha256 from z group by all""")
def tile_resample(spark, d):
    """Tiles of 8 x 8 pixels at zoom 14, each pixel's centre sampled from the grid and encoded, by digest."""
    ranges = raster.tile_ranges(_boxes(spark, d).drop("nation"), [14])
    pixels = raster.tile_pixels(ranges, 8).distinct()
    rows = _rows(spark, d)
    at = pixels.selectExpr("zoom", "x tx", "y ty", "row pr", "column pc", f"{_X} x", f"{_Y.format(rows=rows)} y")
    z = raster.bilinear(at, B.shape(spark, d, "raster"), _COLUMNS, rows, key=["zoom", "tx", "ty", "pr", "pc"], clamp=True)
    return raster.encoded_tiles(z.select("zoom", F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("pr").alias("row"), F.col("pc").alias("column"), F.round("z", 3).alias("z")))


_PROFILE = f"""(with v as (select line, pos, lat, lng from {B.sql('polylines')}), s as (select a.line, a.pos, a.lat, a.lng, coalesce({Q.distance('b', 'a')}, 0) step from v a left join v b on a.line = b.line and b.pos = a.pos - 1),
 c as (select *, sum(step) over (partition by line order by pos) along from s),
 l as (select *, lead(along) over w to_m, lead(lat) over w lat2, lead(lng) over w lng2, lead(pos) over w np, max(along) over (partition by line) length, max(pos) over (partition by line) last from c window w as (partition by line order by pos)),
 u as (select *, greatest(1, cast(ceil(length / 500) as int)) n from l where np is not null and length > 0 and to_m > along), k as (select *, length / n gap from u),
 e as (select *, unnest(range(cast(ceil(along / gap) as int), 1 + least(n, case when np = last then n else cast(ceil(to_m / gap) as int) - 1 end))) k from k)
 select line, cast(k as int) k, gap, round(lat + (lat2 - lat) * least(1e0, (least(k * gap, length) - along) / (to_m - along)), 8) lat, round(lng + (lng2 - lng) * least(1e0, (least(k * gap, length) - along) / (to_m - along)), 8) lng from e)"""
_PROFILE_Z = _bilinear_sql(f"(select line, k, {_X} x, {_Y.format(rows=_ROWS)} y from {_PROFILE})", "line, k", True)


@query(f"""with z as materialized (select line, k, round(z, 6) z from ({_PROFILE_Z})), g as (select line, any_value(gap) gap from {_PROFILE} group by 1), s as (select z.*, z - lag(z) over (partition by line order by k) d, gap from z join g using (line))
 select line, count(*) samples, arg_min(z, k) start_m, arg_max(z, k) end_m, min(z) low_m, max(z) high_m, round(coalesce(sum(greatest(d, 0) order by k), 0), 6) ascent_m, round(coalesce(sum(greatest(-d, 0) order by k), 0), 6) descent_m,
 round(coalesce(max(d / gap * 100), 0), 2) max_grade, round(coalesce(min(d / gap * 100), 0), 2) min_grade from s group by line""")
def route_profiles(spark, d):
    """Elevations along each line at equal spacing, with climbs, ends and steepest grades."""
    lines = B.polylines(spark, d).select("line", "pos", "lat", "lng")
    at = sequences.resample(lines, 500.0)
    rows = _rows(spark, d)
    z = raster.bilinear(at.selectExpr("line", "k", "gap_m", f"{_X} x", f"{_Y.format(rows=rows)} y"), B.shape(spark, d, "raster"), _COLUMNS, rows, key=["line", "k", "gap_m"], clamp=True)
    return sequences.profile_summary(z.withColumn("z", F.round("z", 6)), digits=6)


_META = ["p_partkey id", "case p_partkey % 7 when 0 then 'PNG' else 'TIFF' end format", "case p_partkey % 5 when 0 then 16 else 32 end bits", "case p_partkey % 11 when 0 then 2e0 else 1e0 end cell", "case p_partkey % 6 when 0 then null else -9999e0 end nodata", "case p_partkey % 8 when 0 then 4326 else 25832 end crs", "526677e0 + p_partkey west", "5685981e0 north", "3098 width", "2096 + p_partkey % 700 height"]
_SEMANTICS = {"float_tiff": "format = 'TIFF'", "bits_32": "bits = 32", "metre_cells": "cell = 1", "nodata_value": "nodata = -9999", "zone_32": "crs = 25832", "area_within_cap": "width * height <= 8000000"}


@query(f"with m as (select {', '.join(_META)} from part) " + " union all ".join(f"select '{n}' rule, count(*) checked, count_if(not coalesce({r}, false)) failures, min(case when not coalesce({r}, false) then id end) first_failure from m" for n, r in _SEMANTICS.items()))
def raster_semantics(spark, d):
    """What a raster must declare before it is read, as a report."""
    meta = B.table(spark, d, "part").selectExpr(*_META)
    return contracts.report(meta, {n: F.expr(r) for n, r in _SEMANTICS.items()}, "id")


@query(f"select id, west, north - height * cell south, west + width * cell east, north from (select {', '.join(_META)} from part)")
def raster_bounds(spark, d):
    """Bounds from the north-west corner, size and cell."""
    meta = B.table(spark, d, "part").selectExpr(*_META)
    return meta.select("id", raster.bounds_from_tiepoint(*(F.col(c) for c in ("west", "north", "width", "height", "cell"))).alias("b")).select("id", "b.*")
