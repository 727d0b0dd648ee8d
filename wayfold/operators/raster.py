"""Elevation grids as tables (row, col, z): samples, statistics, tiles. Cells are joined by row and column, never gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo

#: What a cell without elevation holds, metres around an area of interest and the most, and the most cells of one.
NODATA, MARGIN_M, MOST_MARGIN_M, MOST_CELLS = -9999.0, 150.0, 250.0, 8_000_000


def nearest(points: DataFrame, grid: DataFrame, columns: int, rows: int) -> DataFrame:
    """``points`` with z of the cell that each lies in; x and y are in cells from the grid's west and north edge. Null outside, where cells
    own their west and north edges, and where the cell has no elevation."""
    inside = geo.in_half_open_box(F.col("x"), -F.col("y"), (0.0, -float(rows), float(columns), 0.0))
    at = points.withColumn("_row", F.when(inside, F.floor("y"))).withColumn("_col", F.when(inside, F.floor("x")))
    cells = grid.select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.when(F.col("z") != NODATA, F.col("z")).alias("z"))
    return at.join(cells, ["_row", "_col"], "left").drop("_row", "_col")


def bilinear(points: DataFrame, grid: DataFrame, columns: int, rows: int, *, key: list[str], clamp: bool) -> DataFrame:
    """(key, z): elevations between the centres of four cells, weighted by nearness. Points beyond the outer centres take the edge's cells.

    Points outside the grid are null, or count as on its edge with ``clamp``; so are points near a cell that isn't there or holds none.
    The four cells are brought together once for each place in the grid and not for each point, which then meets them in one row.
    """
    x, y = F.col("x"), F.col("y")
    inside = x.between(0.0, float(columns)) & y.between(0.0, float(rows))
    e, n = (F.least(F.greatest(v - 0.5, F.lit(0.0)), F.lit(float(most - 1))) for v, most in ((x, columns), (y, rows)))
    at = points.select(*key, F.when(F.lit(clamp) | inside, e).alias("_e"), F.when(F.lit(clamp) | inside, n).alias("_n"))
    corners = [(i, j) for i in (0, 1) for j in (0, 1)]
    held = grid.filter(F.col("z") != NODATA).select(F.explode(F.array(*(F.struct((F.col("row") - i).alias("row"), (F.col("col") - j).alias("col"), F.lit(2 * i + j).alias("k"), F.col("z").cast("double").alias("z")) for i, j in corners))).alias("c")).select("c.*")
    four = held.groupBy("row", "col").agg(*(F.max(F.when(F.col("k") == k, F.col("z"))).alias(f"_z{k}") for k in range(4)))
    found = at.join(four, (F.floor("_n") == F.col("row")) & (F.floor("_e") == F.col("col")), "left")
    weight = lambda v, k: F.col(v) - F.floor(v) if k else 1 - F.col(v) + F.floor(v)
    shares = [weight("_n", i) * weight("_e", j) for i, j in corners]
    missing, total = F.lit(False), F.lit(0.0)
    for k, share in enumerate(shares):
        z = F.col(f"_z{k}")
        missing, total = missing | (z.isNull() & (F.coalesce(share, F.lit(1.0)) > 0)), total + F.coalesce(z * share, F.lit(0.0))
    return found.select(*key, F.when(~missing, total).alias("z"))


def statistics(grid: DataFrame) -> DataFrame:
    """(n, low, high, n_nodata, all_finite) of a grid; low and high of cells with an elevation."""
    known = F.when(F.col("z") != NODATA, F.col("z"))
    finite = F.coalesce(geo.finite(F.col("z")).isNotNull(), F.lit(False))
    return grid.agg(F.count(F.lit(1)).alias("n"), F.min(known).alias("low"), F.max(known).alias("high"), F.count_if(F.col("z") == NODATA).alias("n_nodata"), F.bool_and(finite).alias("all_finite"))


def differences(one: DataFrame, other: DataFrame) -> DataFrame:
    """(row, col, one, other): cells that two grids don't have alike, missing ones included."""
    j = one.select("row", "col", F.col("z").alias("one")).join(other.select("row", "col", F.col("z").alias("other")), ["row", "col"], "full")
    return j.filter(~F.col("one").eqNullSafe(F.col("other")))


def area_of_interest(boxes: DataFrame, by: str, margin: float = MARGIN_M) -> DataFrame:
    """(by, west, south, east, north, cells): boxes (by, south, west, north, east in degrees) projected by their corners, padded, in whole metres.

    A margin beyond MOST_MARGIN_M is an error, and so is an area of more than MOST_CELLS square metres.
    """
    if not 0 <= margin <= MOST_MARGIN_M:
        raise ValueError(f"the margin must be between 0 and {MOST_MARGIN_M:g} m")
    at = boxes.withColumn("c", geo.box_corners(F.col("west"), F.col("south"), F.col("east"), F.col("north"), geo.utm32))
    low = lambda a: F.floor(F.array_min(a) - margin).cast("long")
    high = lambda a: F.ceil(F.array_max(a) + margin).cast("long")
    out = at.select(by, low("c.x").alias("west"), low("c.y").alias("south"), high("c.x").alias("east"), high("c.y").alias("north"))
    cells = (F.col("east") - F.col("west")) * (F.col("north") - F.col("south"))
    fits = F.when(cells <= MOST_CELLS, cells).otherwise(F.raise_error(F.concat(F.lit("an area of too many cells: "), cells.cast("string"))).cast("long"))
    return out.withColumn("cells", fits)


def tile_ranges(boxes: DataFrame, zooms: list[int]) -> DataFrame:
    """``boxes`` (south, west, north, east, ...) by zoom with x_min, x_max, y_min, y_max and tiles; an edge on a tile's border doesn't touch the next."""
    at = boxes.withColumn("zoom", F.explode(F.array(*map(F.lit, zooms))))
    x0, y1 = geo.tile_fraction(F.col("south"), F.col("west"), F.col("zoom"))
    x1, y0 = geo.tile_fraction(F.col("north"), F.col("east"), F.col("zoom"))
    out = at.withColumn("x_min", F.floor(x0).cast("long")).withColumn("x_max", (F.ceil(x1) - 1).cast("long")).withColumn("y_min", F.floor(y0).cast("long")).withColumn("y_max", (F.ceil(y1) - 1).cast("long"))
    return out.withColumn("tiles", (F.col("x_max") - F.col("x_min") + 1) * (F.col("y_max") - F.col("y_min") + 1))


def tile_pixels(ranges: DataFrame, size: int) -> DataFrame:
    """(zoom, x, y, row, column, lat, lng): the pixel centres of every tile of tile_ranges() rows."""
    tiles = ranges.select("zoom", F.explode(F.sequence("x_min", "x_max")).alias("x"), "y_min", "y_max").select("zoom", "x", F.explode(F.sequence("y_min", "y_max")).alias("y"))
    pixels = tiles.select("zoom", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("column"))
    lat, lng = geo.pixel_center(F.col("zoom"), F.col("x"), F.col("y"), F.col("column"), F.col("row"), size)
    return pixels.withColumn("lat", lat).withColumn("lng", lng)


def encoded_tiles(pixels: DataFrame) -> DataFrame:
    """(zoom, x, y, n_pixels, sha256): tiles of pixels (zoom, x, y, row, column, z) as red, green and blue bytes row by row, and their digest.

    A tile's pixels are of a fixed number.
    """
    rgb = F.concat(*(F.lpad(F.hex(c), 2, "0") for c in geo.terrarium(F.col("z"))))
    rows = F.array_sort(F.collect_list(F.struct("row", "column", rgb.alias("rgb"))))
    whole = F.unhex(F.array_join(F.transform(rows, lambda p: p["rgb"]), ""))
    return pixels.groupBy("zoom", "x", "y").agg(F.count(F.lit(1)).alias("n_pixels"), F.sha2(whole, 256).alias("sha256"))


def bounds_from_tiepoint(west: Column, north: Column, width: Column, height: Column, cell: Column) -> Column:
    """(west, south, east, north) of a raster from its north-west corner, its size and its cells' width."""
    return F.struct(west.alias("west"), (north - height * cell).alias("south"), (west + width * cell).alias("east"), north.alias("north"))
