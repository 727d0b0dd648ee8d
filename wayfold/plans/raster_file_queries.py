"""Elevation grids written as files and read back: GeoTIFF mosaics, packed blocks, pyramids of tiles with their manifest and gate."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators import raster
from wayfold.plans import bindings as B
from wayfold.plans import terrain_queries as P
from wayfold.plans.registry import query
from wayfold.sources import files, grids, geotiff
from wayfold.sources.scratch import shared_dir

_WEST, _NORTH = 526677.0, 5685981.0
_COLUMNS, _ROWS = 50, P._ROWS
#: Rows and columns of a file of the mosaic, neither of which divides the grid's.
_FILE = (24, 32)
#: The whole rectangle: cells that no part gives have no elevation.
_CELLS = f'(select r.range "row", c.range col, coalesce(z, -9999)::double z from range({_ROWS}) r, range({_COLUMNS}) c left join {B.sql("raster")} g on g.row = r.range and g.col = c.range)'


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/scratch/{name}-{uuid.uuid4().hex}"


def _size(spark, d) -> dict:
    return {"rows": P._rows(spark, d), "columns": _COLUMNS}


def _grid(spark, d) -> DataFrame:
    return B.shape(spark, d, "raster")


def _mosaic(spark, d) -> str:
    folder = _folder(spark, "mosaic")
    grids.write_mosaic(_grid(spark, d), folder, **_size(spark, d), west=_WEST, north=_NORTH, block=_FILE, rows_per_strip=5)
    return folder


@query(f'select "row", col, z from {_CELLS}')
def geotiff_cells(spark, d):
    """The cells of a mosaic of GeoTIFF files, a file shared by several tasks, at their places in the whole grid."""
    cells = grids.read_mosaic(spark, _mosaic(spark, d), west=_WEST, north=_NORTH, bytes_per_task=2048)
    return cells.select("row", "col", F.col("z").cast("double").alias("z"))


@query(f"""select printf('r%d_c%d.tif', r, c) file, least(24, {_ROWS} - r)::int height, least(32, 50 - c)::int width, 32 bits, 3 sample_format, 8 compression, {_WEST}::double + c west, {_NORTH}::double - r north, {_WEST}::double + least(c + 32, 50) east, {_NORTH}::double - least(r + 24, {_ROWS}) south, 25832 epsg, -9999e0 nodata
 from (select range r from range(0, {_ROWS}, 24)), (select range c from range(0, 50, 32))""")
def geotiff_headers(spark, d):
    """What each file of a mosaic declares, and its bounds from its corner, cells and size."""
    rows = geotiff.read_headers(spark, _mosaic(spark, d))
    bounds = raster.bounds_from_tiepoint(F.col("west"), F.col("north"), F.col("width"), F.col("height"), F.col("cell_x"))
    return rows.withColumn("b", bounds).select("file", "height", "width", "bits", "sample_format", "compression", "west", "north", "b.east", "b.south", "epsg", "nodata")


@query(f'select "row", col, z from {_CELLS}')
def packed_cells(spark, d):
    """A grid packed without loss, byte planes apart, and read back against its manifest."""
    folder = _folder(spark, "packed")
    grids.write_packed(_grid(spark, d), folder, **_size(spark, d), block=20)
    return grids.read_packed(spark, folder).select("row", "col", F.col("z").cast("double").alias("z"))


_RULES = {"finite": "not isfinite(z)", "no_nodata": "z = -9999", "plausible": "z <> -9999 and (z <= 220 or z >= 360)"}


@query(f"""with c as (select * from {_CELLS}), r as ({" union all ".join(f"select '{n}' rule, count_if({r}) failures from c" for n, r in _RULES.items())} union all select 'files_hold_bytes', 0),
 b as (select least("row" // 20, 9999) i, col // 20 j, count(*) n from c group by all) select rule, failures, failures = 0 ok, (select count(*) from b) files, true same_digest from r""")
def packed_manifest(spark, d):
    """The build of a packed grid: its checks, its files, and one digest for two writes in different partitions."""
    grid = _grid(spark, d)
    one, other = (_folder(spark, "packed") for _ in range(2))
    listed = grids.write_packed(grid, one, **_size(spark, d), block=20)
    again = grids.write_packed(grid.repartition(7, "col"), other, **_size(spark, d), block=20)
    same = grids.grid_digest(listed).select("content_hash").join(grids.grid_digest(again).select("content_hash"), "content_hash").agg((F.count(F.lit(1)) == 1).alias("same_digest"))
    report = grids.build_report(grids.read_packed(spark, one), listed, 220.0, 360.0)
    # one row
    return report.withColumn("files", F.lit(files.head(one)["files"]).cast("long")).join(F.broadcast(same))


def _pixels(spark, d) -> DataFrame:
    """The pixels of tiles of 8 x 8 at zoom 14 that the customers' places take."""
    ranges = raster.tile_ranges(P._boxes(spark, d).drop("nation"), [14])
    rows = P._rows(spark, d)
    at = raster.tile_pixels(ranges, 8).distinct().selectExpr("zoom", "x tx", "y ty", "row pr", "column pc", f"{P._X} x", f"{P._Y.format(rows=rows)} y")
    z = raster.bilinear(at, _grid(spark, d), _COLUMNS, rows, key=["zoom", "tx", "ty", "pr", "pc"], clamp=True)
    return z.select("zoom", F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("pr").alias("row"), F.col("pc").alias("column"), F.round("z", 3).alias("z"))


_TILES = f"""z as materialized (select *, cast(round_even((round(z, 3) + 32768) * 256, 0) as bigint) q from ({P._PIXEL_Z})),
 t as materialized (select zoom, tx x, ty y, count(*) n_pixels, sha256(unhex(string_agg(printf('%06X', q), '' order by pr, pc))) sha256 from z group by all)"""


@query(f"with {_TILES} select zoom, x, y, 8 width, 8 height, 'RGB' mode, n_pixels, sha256 pixels_sha256, true listed from t")
def tile_files(spark, d):
    """A pyramid's tiles as PNG files, read back: each is in the manifest, and its pixels are those that were sampled."""
    folder = _folder(spark, "tiles")
    listed = grids.write_files_of_tiles(_pixels(spark, d), folder, 8)
    tiles = grids.decoded_tiles(files.read_files(spark, folder))
    named = tiles.join(listed.withColumn("listed", F.lit(True)).select("path", F.col("bytes").alias("listed_bytes"), "listed"), "path", "left")
    return named.select("zoom", "x", "y", "width", "height", "mode", (F.length("pixels") / 3).cast("long").alias("n_pixels"), F.sha2("pixels", 256).alias("pixels_sha256"), ((F.col("listed_bytes") == F.col("bytes")) & F.col("listed")).alias("listed"))


#: What befalls tiles between writing and the gate, by their place; one more tile turns up that no one has listed.
_FATES = {"missing": "(x + y) % 11 = 0", "cut": "(x + y) % 11 = 1", "changed": "(x + y) % 11 = 2", "gray": "(x + y) % 11 = 3", "large": "(x + y) % 11 = 4"}
_GATE = {
    "repeated": "0", "missing": "count_if(fate = 'missing')", "unlisted": "1", "bytes": "count_if(fate in ('cut', 'gray', 'large'))", "sha256": "count_if(fate = 'changed')",
    "readable": "count_if(fate in ('cut', 'changed'))", "size": "count_if(fate = 'large')", "mode": "count_if(fate = 'gray')", "budget": "1", "quantum": "64 * count_if(fate <> 'fine')",
}


@query(f"""with {_TILES}, f as (select *, case {" ".join(f"when {c} then '{k}'" for k, c in _FATES.items())} else 'fine' end fate from t)
 select u.rule, u.failures::bigint failures, u.failures = 0 ok from (select unnest([{", ".join(f"{{'rule': '{k}', 'failures': {c}}}" for k, c in _GATE.items())}]) u from f)""")
def tile_gate(spark, d):
    """The gate of a pyramid, some tiles of which were lost, cut off, changed or replaced by a gray or larger image after they had been listed."""
    folder = _folder(spark, "tiles")
    pixels = _pixels(spark, d)
    listed = grids.write_files_of_tiles(pixels, folder, 8)
    tiles = files.contents(spark, folder).select("path", "content", *grids.tile_key("path"))
    gray, large = (F.lit(bytearray(c)) for c in grids.odd_images(8))
    fate = lambda k: F.expr(_FATES[k])
    last = F.length("content")
    changed = F.concat(F.expr("substring(content, 1, length(content) - 1)"), F.unhex(F.lpad(F.hex((F.conv(F.hex(F.expr("substring(content, length(content), 1)")), 16, 10).cast("int") + 1) % 256), 2, "0")))
    content = F.when(fate("cut"), F.expr("substring(content, 1, length(content) - 3)")).when(fate("changed"), changed).when(fate("gray"), gray).when(fate("large"), large).otherwise(F.col("content"))
    found = tiles.filter(~fate("missing")).select("path", content.alias("content"))
    stray = tiles.orderBy("path").limit(1).select(F.lit("0/0/0.png").alias("path"), F.lit(bytearray(grids.plain_image(8))).alias("content"))
    return grids.tile_gate(listed, found.unionByName(stray), size=8, most_bytes=1, source=pixels)
