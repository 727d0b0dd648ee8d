"""Elevation grids (row, col, z) as files and back: GeoTIFF mosaics, packed blocks without loss, and pyramids of PNG tiles.

A grid is cut into blocks of a fixed number of cells (or pixels); Spark brings a block's cells together, one task encodes it, and the file sink writes it. No
task holds more than a block, and a file's bytes depend on its cells alone, not on who wrote them.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.raster import NODATA
from wayfold.sources import files, geotiff, layers

#: Cells along a block's edge, pixels along a tile's, and the most bytes of a pyramid unless told otherwise.
BLOCK, TILE, MOST_BYTES = 256, 256, 8 * 1024 * 1024
#: Fixed values of the tile encoding: the offset of elevations in metres and the steps in a metre.
OFFSET_M, STEPS = 32768.0, 256.0
FILE = "path string, content binary"


def _filled(table: pa.Table, row0: int, col0: int, rows: int, columns: int) -> np.ndarray:
    """A block's cells, NODATA where the table has none; two rows for one cell fail."""
    at = (table.column("row").to_numpy() - row0) * columns + table.column("col").to_numpy() - col0
    if len(np.unique(at)) < len(at):
        raise ValueError(f"two rows for one cell of the block at row {row0}, column {col0}")
    out = np.full(rows * columns, NODATA, np.float32)
    out[at] = table.column("z").to_numpy()
    return out.reshape(rows, columns)


def _blocks(grid: DataFrame, block_rows: int, block_columns: int, rows: int, columns: int, encoder: Callable[[np.ndarray, int, int], tuple[str, bytes]]) -> DataFrame:
    """(path, content): every block of a grid of rows x columns cells through ``encoder``, also blocks that no cell is given of. Cells outside fail."""

    def run(table: pa.Table) -> pa.Table:
        r, c = table.column("block_row")[0].as_py(), table.column("block_col")[0].as_py()
        cells = _filled(table.filter(table.column("row").is_valid()), r * block_rows, c * block_columns, min(block_rows, rows - r * block_rows), min(block_columns, columns - c * block_columns))
        path, content = encoder(cells, r * block_rows, c * block_columns)
        return pa.table({"path": pa.array([path]), "content": pa.array([content], pa.binary())})

    inside = F.col("row").between(0, rows - 1) & F.col("col").between(0, columns - 1)
    fail = F.raise_error(F.format_string("cell outside a grid of %d x %d: %d, %d", F.lit(rows), F.lit(columns), F.col("row").cast("long"), F.col("col").cast("long"))).cast("boolean")
    cells = grid.filter(F.when(inside, F.lit(True)).otherwise(fail)).select(F.floor(F.col("row") / block_rows).cast("int").alias("block_row"), F.floor(F.col("col") / block_columns).cast("int").alias("block_col"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("z").cast("float").alias("z"))
    spark = grid.sparkSession
    none = [F.lit(None).cast(t).alias(n) for n, t in (("row", "long"), ("col", "long"), ("z", "float"))]
    across = -(-columns // block_columns)
    every = spark.range(-(-rows // block_rows) * across).select(F.floor(F.col("id") / across).cast("int").alias("block_row"), (F.col("id") % across).cast("int").alias("block_col"), *none)
    return cells.unionByName(every).groupBy("block_row", "block_col").applyInArrow(run, FILE)


# -- GeoTIFF mosaics -----------------------------------------------------------------------------------------------------------------


def write_mosaic(grid: DataFrame, folder: str, *, rows: int, columns: int, west: float, north: float, cell: float = 1.0, block: tuple[int, int] = (BLOCK, BLOCK), epsg: int = 25832, deflate: bool = True, rows_per_strip: int = 64) -> DataFrame:
    """A GeoTIFF file for each block of ``grid``, with its own corner; returns the manifest. Cells that the table lacks hold NODATA."""

    def encoder(cells: np.ndarray, row: int, col: int) -> tuple[str, bytes]:
        return f"r{row}_c{col}.tif", geotiff.encode(cells, west + col * cell, north - row * cell, cell=cell, epsg=epsg, deflate=deflate, rows_per_strip=rows_per_strip)

    return files.write_files(_blocks(grid, *block, rows, columns, encoder), folder)


def read_mosaic(spark: SparkSession, folder: str, *, west: float, north: float, cell: float = 1.0, **options) -> DataFrame:
    """(row, col, z) of all files of a folder, counted in cells from a corner. Files of another cell width, system or NODATA fail."""
    cells = geotiff.read_cells(spark, folder, **({"cell": cell, "epsg": 25832, "nodata": NODATA} | options))
    place = lambda c: F.round(c / cell).cast("long")
    return cells.select(place(north - F.col("y")).alias("row"), place(F.col("x") - west).alias("col"), "z")


# -- packed blocks without loss ------------------------------------------------------------------------------------------------------

#: When every archive member was last changed: a fixed value, so that equal cells give equal bytes.
_STAMP = (1980, 1, 1, 0, 0, 0)


def pack(cells: np.ndarray) -> bytes:
    """32-bit cells as an archive of two arrays: their bytes, the lowest of all cells first and the highest last, and their shape. Nothing is rounded."""
    little = np.ascontiguousarray(cells, "<f4")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as archive:
        for name, array in (("planes", little.view(np.uint8).reshape(-1, 4).T), ("shape", np.array(little.shape, "<i8"))):
            member = io.BytesIO()
            np.save(member, np.ascontiguousarray(array), allow_pickle=False)
            info = zipfile.ZipInfo(f"{name}.npy", _STAMP)
            info.compress_type, info.create_system, info.external_attr = zipfile.ZIP_DEFLATED, 3, 0o644 << 16
            archive.writestr(info, member.getvalue(), compresslevel=9)
    return out.getvalue()


def unpack(content: bytes) -> np.ndarray:
    """The cells of pack(), bit by bit; an archive that holds anything else fails."""
    with np.load(io.BytesIO(content), allow_pickle=False) as archive:
        planes, shape = archive["planes"], archive["shape"]
    if planes.dtype != np.uint8 or planes.ndim != 2 or planes.shape[0] != 4 or shape.shape != (2,) or planes.shape[1] != shape.prod():
        raise ValueError(f"not the planes of a block: {planes.dtype} {planes.shape} for cells {shape.tolist()}")
    return np.ascontiguousarray(planes.T).view("<f4").reshape(shape)


def write_packed(grid: DataFrame, folder: str, *, rows: int, columns: int, block: int = BLOCK) -> DataFrame:
    """Every block of ``grid`` packed into a file of its own; returns the manifest. Cells that the table lacks hold NODATA."""
    return files.write_files(_blocks(grid, block, block, rows, columns, lambda cells, row, col: (f"b{row}_{col}.npz", pack(cells))), folder)


def read_packed(spark: SparkSession, folder: str) -> DataFrame:
    """(row, col, z) of a folder of packed blocks; a file that isn't the one of the manifest fails by its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                row, col = map(int, path.as_py().rpartition("/")[2][1:-4].split("_"))
                cells = unpack(content.as_py())
                n, m = cells.shape
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(row, row + n), m)), pa.array(np.tile(np.arange(col, col + m), n)), pa.array(cells.ravel())], ["row", "col", "z"])

    return files.read_files(spark, folder).mapInArrow(run, "row bigint, col bigint, z float")


def grid_digest(manifest: DataFrame) -> DataFrame:
    """(layer, n_rows, content_hash) of a manifest's files: equal for equal grids, whatever the partitions and order they were written in."""
    return layers.content_hash(manifest.select("path", "sha256"), "grid")


def build_report(grid: DataFrame, manifest: DataFrame, low: float, high: float) -> DataFrame:
    """(rule, failures, ok) of a grid that is to be published: finite cells, none without elevation, all within low and high; and its files add up."""
    z = F.col("z").cast("double")
    known = z != NODATA
    count = lambda c: F.count_if(F.coalesce(c, F.lit(True)))
    cells = grid.agg(count(F.isnan(z) | (F.abs(z) == float("inf"))).alias("finite"), count(~known).alias("no_nodata"), count(known & ((z <= low) | (z >= high))).alias("plausible"))
    empty = manifest.agg(count(F.col("bytes") <= 0).alias("files_hold_bytes"))
    rules = lambda df: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("rule"), F.col(c).alias("failures")) for c in df.columns))).alias("r")).select("r.*")
    return rules(cells).unionByName(rules(empty)).withColumn("ok", F.col("failures") == 0)


# -- pyramids of PNG tiles -----------------------------------------------------------------------------------------------------------

_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(rgb: np.ndarray) -> bytes:
    """An image of height x width x 3 bytes, rows unfiltered."""
    height, width, _ = rgb.shape

    lines = np.zeros((height, 1 + 3 * width), np.uint8)
    lines[:, 1:] = rgb.reshape(height, -1)
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 9)) + _chunk(b"IEND", b"")


def decode_png(content: bytes) -> tuple[int, int, str, np.ndarray | None]:
    """(width, height, mode, pixels) of an image; pixels only of 8-bit RGB. Wrong checksums, missing ends and interlacing fail."""
    if content[:8] != _SIGNATURE:
        raise ValueError("no PNG file")
    at, head, data, ended = 8, None, [], False
    while at < len(content) and not ended:
        if at + 12 > len(content):
            raise ValueError("cut off")
        n = struct.unpack_from(">I", content, at)[0]
        kind, body = content[at + 4 : at + 8], content[at + 8 : at + 8 + n]
        if len(content) < at + 12 + n or zlib.crc32(kind + body) != struct.unpack_from(">I", content, at + 8 + n)[0]:
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if not ended or head is None or at != len(content):
        raise ValueError("cut off or followed by other bytes")
    width, height, depth, color, *_, interlaced = head
    mode = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(color, "?") if depth == 8 else f"{color}/{depth}"
    if mode != "RGB" or interlaced:
        return width, height, mode if not interlaced else "interlaced", None
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + 3 * width)
    out = np.zeros((height, width, 3), np.uint8)
    for i, line in enumerate(lines):
        above = out[i - 1] if i else np.zeros((width, 3), np.uint8)
        own = line[1:].reshape(width, 3)
        if line[0] == 0:
            out[i] = own
        elif line[0] == 1:
            out[i] = np.cumsum(own, axis=0, dtype=np.uint8)
        elif line[0] == 2:
            out[i] = own + above
        else:
            raise ValueError(f"row filter {line[0]} isn't read")
    return width, height, mode, out


def terrarium_rgb(z: np.ndarray) -> np.ndarray:
    """Elevations as red, green and blue, rounded half to even; what three bytes can't hold fails."""
    q = np.rint((z.astype(np.float64) + OFFSET_M) * STEPS)
    if not np.isfinite(q).all() or (q < 0).any() or (q > (1 << 24) - 1).any():
        raise ValueError("elevation outside the encoding's range")
    q = q.astype(np.uint32)
    return np.stack([q >> 16, q >> 8 & 255, q & 255], axis=-1).astype(np.uint8)


def tile_files(pixels: DataFrame, size: int = TILE) -> DataFrame:
    """(path, content): a PNG file zoom/x/y for each tile of pixels (zoom, x, y, row, column, z); a tile that lacks a pixel fails."""

    def run(table: pa.Table) -> pa.Table:
        zoom, x, y = (table.column(c)[0].as_py() for c in ("zoom", "x", "y"))
        at = table.column("row").to_numpy() * size + table.column("column").to_numpy()
        z = np.full(size * size, np.nan)
        z[at] = table.column("z").to_numpy()
        if table.num_rows != size * size or np.isnan(z).any():
            raise ValueError(f"tile {zoom}/{x}/{y} has {table.num_rows} pixels of {size * size}, or some without elevation")
        return pa.table({"path": pa.array([f"{zoom}/{x}/{y}.png"]), "content": pa.array([encode_png(terrarium_rgb(z.reshape(size, size)))], pa.binary())})

    cells = pixels.select("zoom", "x", "y", F.col("row").cast("long").alias("row"), F.col("column").cast("long").alias("column"), F.col("z").cast("double").alias("z"))
    return cells.groupBy("zoom", "x", "y").applyInArrow(run, FILE)


def write_files_of_tiles(pixels: DataFrame, folder: str, size: int = TILE) -> DataFrame:
    """tile_files() as files; returns the manifest."""
    return files.write_files(tile_files(pixels, size), folder)


def plain_image(size: int) -> bytes:
    """An image of one elevation, sea level."""
    return encode_png(terrarium_rgb(np.zeros((size, size))))


def odd_images(size: int) -> tuple[bytes, bytes]:
    """An image in gray and one of another size, for tests of gates."""
    header = struct.pack(">IIBBBBB", size, size, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(b"\0" * (size + 1) * size, 9)) + _chunk(b"IEND", b""), plain_image(size * 2)


def tile_key(path: str) -> list[Column]:
    """zoom, x and y of a tile's path."""
    return [F.regexp_extract(F.col(path), r"(\d+)/(\d+)/(\d+)\.png$", i + 1).cast("bigint").alias(n) for i, n in enumerate(("zoom", "x", "y"))]


TILE_ROW = "path string, zoom bigint, x bigint, y bigint, bytes bigint, fault string, width int, height int, mode string, pixels binary"


def decoded_tiles(tiles: DataFrame) -> DataFrame:
    """(path, zoom, x, y, bytes, fault, width, height, mode, pixels) of files (path, content): what each image is, or why it can't be read; pixels are its
    red, green and blue bytes row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            faults, width, height, mode, pixels = [], [], [], [], []
            for content in batch.column("content"):
                data = content.as_py() or b""
                try:
                    w, h, m, rgb = decode_png(data)
                    found = (None, w, h, m, None if rgb is None else rgb.tobytes())
                except (ValueError, zlib.error, struct.error) as e:
                    found = (str(e) or "unreadable", None, None, None, None)
                for column, value in zip((faults, width, height, mode, pixels), found, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("path", "zoom", "x", "y", "bytes")), pa.array(faults, pa.string()), pa.array(width, pa.int32()), pa.array(height, pa.int32()), pa.array(mode, pa.string()), pa.array(pixels, pa.binary())],
                [f.split()[0] for f in TILE_ROW.split(", ")],
            )

    return tiles.select("path", *tile_key("path"), F.length("content").cast("long").alias("bytes"), "content").mapInArrow(run, TILE_ROW)


def tile_gate(listed: DataFrame, found: DataFrame, *, size: int = TILE, most_bytes: int = MOST_BYTES, source: DataFrame | None = None) -> DataFrame:
    """(rule, failures, ok) of a pyramid's files (path, content) against its manifest: files as listed, readable, of the tiles' size and mode,
    all within a budget of bytes and, with ``source`` pixels (zoom, x, y, row, column, z), elevations within half a step of theirs.
    """
    wrong = files.faults(listed, found).groupBy("fault").agg(F.count(F.lit(1)).alias("failures"))
    tiles = decoded_tiles(found)
    one = lambda rule, c: F.count_if(F.coalesce(c, F.lit(True))).alias(rule)
    read = F.col("fault").isNull()
    of_size = ~((F.col("width") == size) & (F.col("height") == size))
    sums = tiles.agg(one("readable", ~read), one("size", read & of_size), one("mode", read & (F.col("mode") != "RGB")), F.when(F.coalesce(F.sum("bytes"), F.lit(0)) > most_bytes, 1).otherwise(0).cast("long").alias("budget"))
    rules = ["readable", "size", "mode", "budget"]
    rows = sums.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("failures")) for r in rules))).alias("r")).select("r.*")
    spark = listed.sparkSession
    kinds = spark.createDataFrame([(k,) for k in ("repeated", "missing", "unlisted", "bytes", "sha256")], "rule string")
    # five rows
    rows = kinds.join(F.broadcast(wrong), F.col("rule") == F.col("fault"), "left").select("rule", F.coalesce("failures", F.lit(0)).alias("failures")).unionByName(rows)
    if source is not None:
        rows = rows.unionByName(_beyond_half_a_step(tiles, source, size))
    return rows.withColumn("ok", F.col("failures") == 0)


def _beyond_half_a_step(tiles: DataFrame, source: DataFrame, size: int) -> DataFrame:
    """How many source pixels' elevations the tiles don't hold to within half a step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for zoom, x, y, pixels in zip(*(batch.column(c) for c in ("zoom", "x", "y", "pixels")), strict=True):
                rgb = np.frombuffer(pixels.as_py(), np.uint8).reshape(-1, 3).astype(np.int64)
                n = np.arange(size * size)
                height = (rgb[:, 0] * 65536 + rgb[:, 1] * 256 + rgb[:, 2]) / STEPS - OFFSET_M
                columns = [pa.array(np.full(len(n), v.as_py())) for v in (zoom, x, y)] + [pa.array(n // size), pa.array(n % size), pa.array(height)]
                yield pa.RecordBatch.from_arrays(columns, ["zoom", "x", "y", "row", "column", "height"])

    whole = tiles.filter((F.col("width") == size) & (F.col("height") == size) & F.col("pixels").isNotNull())
    decoded = whole.select("zoom", "x", "y", "pixels").mapInArrow(run, "zoom bigint, x bigint, y bigint, row bigint, column bigint, height double")
    key = ["zoom", "x", "y", "row", "column"]
    both = source.select(*(F.col(c).cast("long").alias(c) for c in key), F.col("z").cast("double").alias("z")).join(decoded, key, "left")
    near = F.abs(F.col("height") - F.col("z")) <= 0.5 / STEPS + 1e-6
    return both.agg(F.lit("quantum").alias("rule"), F.count_if(~F.coalesce(near, F.lit(False))).alias("failures"))
