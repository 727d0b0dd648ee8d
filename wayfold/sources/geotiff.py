"""GeoTIFF elevation files as tables: a reader whose tasks take strips or tiles by byte range, headers as rows, and an encoder of one file a block.

Files are classic or large ones of either byte order, in strips or tiles, plain, Deflate or LZW, with or without the floating-point predictor. Only headers and the wanted
strips are read; a file larger than ``bytes_per_task`` is read by several tasks, and small files share one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wayfold.sources.files import opened

#: The tags of the format that matter here.
TAGS = {
    256: "width", 257: "height", 258: "bits", 259: "compression", 277: "samples", 273: "strip_offsets", 278: "rows_per_strip", 279: "strip_bytes", 317: "predictor", 322: "tile_width", 323: "tile_height",
    324: "tile_offsets", 325: "tile_bytes", 339: "sample_format", 33550: "scale", 33922: "tiepoint", 34735: "geo_keys", 34737: "geo_text", 42113: "nodata",
}
#: Struct codes of field types, the compressions that are read, and the keys of a projected system and its code.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
PROJECTED, NODATA = 3072, -9999.0

CELLS = "file string, row int, col int, x double, y double, z float"
HEADERS = "file string, bytes bigint, width int, height int, bits int, sample_format int, compression int, cell_x double, cell_y double, west double, north double, epsg int, geo_text string, nodata double"


class TiffError(ValueError):
    """A file that isn't what it must be, with its name."""


@dataclass
class Header:
    file: str
    bytes: int
    order: str  #: "<" or ">"
    tags: dict

    def one(self, name: str, default=None):
        value = self.tags.get(name, (default,))
        return value[0] if len(value) else default

    @property
    def epsg(self) -> int | None:
        keys = self.tags.get("geo_keys", ())
        return next((keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] == PROJECTED and keys[i + 1] == 0), None)

    @property
    def nodata(self) -> float | None:
        text = self.tags.get("nodata")
        try:
            return float(text) if text else None
        except ValueError:
            return None

    def row(self) -> tuple:
        scale, tie = (*self.tags.get("scale", ()), None, None)[:2], self.tags.get("tiepoint", ())
        west, north = (tie[3], tie[4]) if len(tie) >= 6 else (None, None)
        return (self.file, self.bytes, self.one("width"), self.one("height"), self.one("bits", 1), self.one("sample_format", 1), self.one("compression", 1), *scale, west, north, self.epsg, self.tags.get("geo_text"), self.nodata)

    def faults(self, epsg: int | None, cell: float | None, nodata: float | None) -> list[str]:
        """What keeps the file from being read as an elevation grid of a system, a cell width and a value for no elevation; None asks for nothing."""
        scale = tuple(self.tags.get("scale", ()))[:2]
        out = []
        if self.one("samples", 1) != 1 or self.one("bits", 1) != 32:
            out.append(f"expected one sample of 32 bits, got {self.one('samples', 1)} of {self.one('bits', 1)}")
        if self.one("sample_format", 1) != 3:
            out.append(f"expected floating-point samples, got format {self.one('sample_format', 1)}")
        if self.one("compression", 1) not in (PLAIN, LZW, DEFLATE, OLD_DEFLATE):
            out.append(f"compression {self.one('compression', 1)} isn't read")
        if self.one("predictor", 1) not in (1, 3):
            out.append(f"predictor {self.one('predictor', 1)} isn't read")
        if len(self.tags.get("tiepoint", ())) < 6 or len(scale) < 2:
            out.append("no tiepoint or cell size")
        elif cell is not None and scale != (cell, cell):
            out.append(f"expected cells of {cell:g} m, got {scale}")
        if nodata is not None and self.nodata != nodata:
            out.append(f"expected {nodata:g} for no elevation, got {self.nodata}")
        if epsg is not None and self.epsg != epsg:
            out.append(f"expected EPSG:{epsg}, got {self.epsg}")
        return out


def read_header(store: fs.FileSystem, path: str, name: str) -> Header:
    """The first directory of a file, by a few reads of its own bytes."""
    size = store.get_file_info(path).size
    with store.open_input_file(path) as f:

        def at(offset: int, n: int) -> bytes:
            if offset < 0 or offset + n > size:
                raise TiffError(f"{name}: cut off at byte {size}")
            return f.read_at(n, offset)

        start = at(0, 8)
        order = {b"II": "<", b"MM": ">"}.get(start[:2])
        kind = struct.unpack(f"{order}H", start[2:4])[0] if order else None
        if kind not in (42, 43):
            raise TiffError(f"{name}: not a TIFF file")
        large = kind == 43
        count, entry, word = ("Q", 20, 8) if large else ("H", 12, 4)
        first = struct.unpack(f"{order}Q", at(8, 8))[0] if large else struct.unpack(f"{order}I", start[4:8])[0]
        n = struct.unpack(f"{order}{count}", at(first, struct.calcsize(count)))[0]
        table = at(first + struct.calcsize(count), n * entry)
        tags = {}
        for i in range(n):
            tag, type_, many = struct.unpack_from(f"{order}HH{'Q' if large else 'I'}", table, i * entry)
            if tag not in TAGS or type_ not in TYPES:
                continue
            code = TYPES[type_]
            width = struct.calcsize(f"{order}{code}") * many
            value_at = i * entry + entry - word
            raw = table[value_at : value_at + width] if width <= word else at(struct.unpack_from(f"{order}{'Q' if large else 'I'}", table, value_at)[0], width)
            tags[TAGS[tag]] = raw.rstrip(b"\0").decode("latin-1") if code == "s" else struct.unpack(f"{order}{code * many if len(code) > 1 else f'{many}{code}'}", raw)
    header = Header(name, size, order, tags)
    if not header.one("width") or not header.one("height"):
        raise TiffError(f"{name}: no size")
    return header


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, that widen one code early; 256 starts a new table and 257 ends."""
    out, table, width, held, bits, last = [], [], 9, 0, 0, None
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def _unpacked(h: Header, data: bytes, columns: int) -> np.ndarray:
    """A strip's or tile's cells, row by row."""
    packing = h.one("compression", 1)
    if packing == LZW:
        data = lzw_decode(data)
    elif packing in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompress(data)
    if len(data) % (4 * columns):
        raise TiffError(f"{h.file}: a strip of {len(data)} bytes isn't whole rows")
    if h.one("predictor", 1) == 3:  # bytes of a row as differences, the highest bytes of all cells first
        planes = np.cumsum(np.frombuffer(data, np.uint8).reshape(-1, 4 * columns), axis=1, dtype=np.uint8).reshape(-1, 4, columns)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(">f4")[..., 0].astype("<f4")
    return np.frombuffer(data, f"{h.order}f4").reshape(-1, columns).astype("<f4")


def strips(store: fs.FileSystem, path: str, h: Header, share: int = 0, shares: int = 1) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, cells) of the share's strips or tiles, each read by its own byte range."""
    width, height = h.one("width"), h.one("height")
    tiled = "tile_offsets" in h.tags
    across, down = (h.one("tile_width"), h.one("tile_height")) if tiled else (width, min(h.one("rows_per_strip", height), height))
    offsets, sizes = (h.tags.get("tile_offsets"), h.tags.get("tile_bytes")) if tiled else (h.tags.get("strip_offsets"), h.tags.get("strip_bytes"))
    by_row = -(-width // across)
    n = by_row * -(-height // down)
    if not offsets or not sizes or min(len(offsets), len(sizes)) < n:
        raise TiffError(f"{h.file}: {n} strips or tiles, but fewer are listed")
    with store.open_input_file(path) as f:
        for i in range(n * share // shares, n * (share + 1) // shares):
            if offsets[i] + sizes[i] > h.bytes:
                raise TiffError(f"{h.file}: cut off at byte {h.bytes}")
            cells = _unpacked(h, f.read_at(sizes[i], offsets[i]), across)
            row, col = i // by_row * down, i % by_row * across
            want = min(down, height - row)
            if len(cells) < want:
                raise TiffError(f"{h.file}: strip {i} has {len(cells)} rows of {want}")
            yield row, col, cells[:want, : min(across, width - col)]


@dataclass
class Pieces(InputPartition):
    """Files, or shares of files: (path, share, shares)."""

    pieces: list

    def __init__(self, pieces: list) -> None:
        self.pieces = pieces


class TiffReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        number = lambda key: float(options[key]) if key in options else None
        self.folder, self.headers = options["path"], options.get("what", "cells") == "headers"
        self.most = int(options.get("bytes_per_task", 1 << 26))
        self.epsg, self.cell, self.nodata = (int(options["epsg"]) if "epsg" in options else None), number("cell"), number("nodata")

    def partitions(self) -> list[Pieces]:
        """Files are listed here, and only their sizes looked at."""
        store, root = opened(self.folder)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.folder)
        files = [info] if info.type == fs.FileType.File else [x for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File and x.extension.lower() in ("tif", "tiff") and not x.base_name.startswith(("_", "."))]
        out, held, size = [], [], 0
        for x in sorted(files, key=lambda x: x.path):
            shares = 1 if self.headers else max(1, -(-x.size // self.most))
            if shares > 1:
                out += [Pieces([(x.path, i, shares)]) for i in range(shares)]
                continue
            weight = min(x.size, 4096) if self.headers else x.size
            if held and size + weight > self.most:
                out.append(Pieces(held))
                held, size = [], 0
            held, size = [*held, (x.path, 0, 1)], size + weight
        return out + ([Pieces(held)] if held or not out else [])

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        store, root = opened(self.folder)
        for path, share, shares in partition.pieces:
            name = path[len(root) + 1 :] if path.startswith(f"{root}/") else path.rpartition("/")[2]
            h = read_header(store, path, name)
            if self.headers:
                yield pa.RecordBatch.from_pylist([dict(zip(_HEADER_SCHEMA.names, h.row(), strict=True))], schema=_HEADER_SCHEMA)
                continue
            if faults := h.faults(self.epsg, self.cell, self.nodata):
                raise TiffError(f"{name}: {'; '.join(faults)}")
            (dx, dy), (west, north) = h.tags["scale"][:2], h.tags["tiepoint"][3:5]
            for row, col, cells in strips(store, path, h, share, shares):
                n, m = cells.shape
                r, c = np.repeat(np.arange(row, row + n, dtype=np.int32), m), np.tile(np.arange(col, col + m, dtype=np.int32), n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(r)), pa.array(r), pa.array(c), pa.array(west + c * dx), pa.array(north - r * dy), pa.array(np.ascontiguousarray(cells).ravel())], schema=_CELL_SCHEMA)


_CELL_SCHEMA = pa.schema([("file", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float32())])
_HEADER_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
_HEADER_SCHEMA = pa.schema([(n, _HEADER_TYPES[t]) for n, t in (x.split() for x in HEADERS.split(", "))])


class GeoTiff(DataSource):
    """``spark.read.format("geotiff").load(path)``: cells, or with ``what=headers`` a row for each file.

    Options: bytes_per_task, and epsg, cell and nodata, which files must have. A file that has others, isn't of one 32-bit floating-point sample or is cut off fails by its name.
    """

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return HEADERS if self.options.get("what", "cells") == "headers" else CELLS

    def reader(self, schema) -> TiffReader:
        return TiffReader(dict(self.options))


def read_cells(spark: SparkSession, path: str, **options) -> DataFrame:
    """(file, row, col, x, y, z) of a file or a folder's files: places in the file, the cell's north-west corner, and its elevation."""
    spark.dataSource.register(GeoTiff)
    return spark.read.format("geotiff").options(**{k: str(v) for k, v in options.items()}).load(path)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """What each file declares: size, samples, compression, cells, north-west corner, system and value for no elevation. Nothing is refused but what isn't TIFF."""
    spark.dataSource.register(GeoTiff)
    return spark.read.format("geotiff").option("what", "headers").load(path)


def encode(cells: np.ndarray, west: float, north: float, *, cell: float = 1.0, epsg: int = 25832, nodata: float = NODATA, deflate: bool = True, rows_per_strip: int = 64) -> bytes:
    """A little-endian classic file of 32-bit floating-point cells in strips; the same cells give the same bytes."""
    height, width = cells.shape
    body = [np.ascontiguousarray(cells[r : r + rows_per_strip], "<f4").tobytes() for r in range(0, height, rows_per_strip)]
    if deflate:
        body = [zlib.compress(b, 9) for b in body]
    sizes = [len(b) for b in body]
    offsets = [8 + sum(sizes[:i]) for i in range(len(body))]
    keys = (1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, PROJECTED, 0, 1, epsg)
    text = f"{nodata:g}".encode() + b"\0"
    fields = [
        (256, "I", [width]), (257, "I", [height]), (258, "H", [32]), (259, "H", [DEFLATE if deflate else PLAIN]), (262, "H", [1]), (273, "I", offsets), (277, "H", [1]), (278, "I", [rows_per_strip]),
        (279, "I", sizes), (339, "H", [3]), (33550, "d", [cell, cell, 0.0]), (33922, "d", [0.0, 0.0, 0.0, west, north, 0.0]), (34735, "H", keys), (42113, "s", text),
    ]
    at = 8 + sum(sizes)
    extra, entries = [], []
    code = {"H": 3, "I": 4, "d": 12, "s": 2}
    for tag, kind, values in fields:
        raw = values if kind == "s" else struct.pack(f"<{len(values)}{kind}", *values)
        if len(raw) > 4:
            place = struct.pack("<I", at + sum(map(len, extra)))
            extra.append(raw + b"\0" * (len(raw) % 2))
        else:
            place = raw.ljust(4, b"\0")
        entries.append(struct.pack("<HHI", tag, code[kind], len(values)) + place)
    directory = at + sum(map(len, extra))
    if directory >= 1 << 32:
        raise ValueError("a block of more than 4 GB: use smaller blocks")
    return struct.pack("<2sHI", b"II", 42, directory) + b"".join(body + extra) + struct.pack("<H", len(entries)) + b"".join(entries) + b"\0\0\0\0"
