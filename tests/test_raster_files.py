"""Grids as files: what is written is read back bit by bit, and what isn't right fails by its name."""

import io
import pathlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfold.sources import files, geotiff, grids


def _lzw(data):
    """Codes of a greedy dictionary, as the decoder reads them."""
    codes, table, width, last = [(256, 9)], {bytes((i,)): i for i in range(256)}, 9, b""
    nxt = 258
    for b in data:
        if last + bytes((b,)) in table:
            last += bytes((b,))
            continue
        codes.append((table[last], width))
        table[last + bytes((b,))] = nxt
        nxt += 1
        width = 9 if nxt < 512 else 10 if nxt < 1024 else 11 if nxt < 2048 else 12
        if nxt == 4095:
            codes.append((256, width))
            table, nxt, width = {bytes((i,)): i for i in range(256)}, 258, 9
        last = bytes((b,))
    if last:
        codes.append((table[last], width))
        nxt += 1
        width = 9 if nxt < 512 else 10 if nxt < 1024 else 11 if nxt < 2048 else 12
    codes.append((257, width))
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def _tiff(cells, *, order="<", large=False, tile=None, rows=3, packing=1, predictor=1, **other):
    """A file written another way than geotiff.encode(): byte order, large offsets, tiles, packings and the predictor."""
    h, w = cells.shape
    if tile:
        parts = []
        for r in range(0, h, tile):
            for c in range(0, w, tile):
                part = np.zeros((tile, tile), np.float32)
                cut = cells[r : r + tile, c : c + tile]
                part[: cut.shape[0], : cut.shape[1]] = cut
                parts.append(part)
    else:
        parts = [cells[r : r + rows] for r in range(0, h, rows)]
    body = []
    for part in parts:
        if predictor == 3:
            planes = part.astype(">f4").view(np.uint8).reshape(part.shape[0], -1, 4).transpose(0, 2, 1).reshape(part.shape[0], -1)
            raw = np.diff(planes, axis=1, prepend=np.zeros((len(planes), 1), np.uint8)).astype(np.uint8).tobytes()
        else:
            raw = part.astype(f"{order}f4").tobytes()
        body.append({1: lambda x: x, 5: _lzw, 8: zlib.compress}[packing](raw))
    word, start = ("Q", 16) if large else ("I", 8)
    offsets = [start + sum(map(len, body[:i])) for i in range(len(body))]
    at, size = (324, 325) if tile else (273, 279)
    fields = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [32]), 259: ("H", [packing]), 277: ("H", [1]), 317: ("H", [predictor]), at: (word, offsets), size: (word, [len(b) for b in body]), 339: ("H", [3])}
    fields |= {322: ("H", [tile]), 323: ("H", [tile])} if tile else {278: ("H", [rows])}
    fields |= {33550: ("d", [1.0, 1.0, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, 500.0, 900.0, 0.0]), 34735: ("H", [1, 1, 0, 1, 3072, 0, 1, 25832]), 42113: ("s", b"-9999\0"), 34737: ("s", b"zone 32|\0")}
    fields |= other.get("fields", {})
    pos = start + sum(map(len, body))
    extra, table = b"", b""
    for tag, (kind, values) in sorted(fields.items()):
        raw = values if kind == "s" else struct.pack(f"{order}{len(values)}{kind}", *values)
        room = 8 if large else 4
        place = raw.ljust(room, b"\0")
        if len(raw) > room:
            place = struct.pack(f"{order}{word}", pos + len(extra))
            extra += raw
        table += struct.pack(f"{order}HH{word}", tag, {"H": 3, "I": 4, "d": 12, "s": 2, "Q": 16}[kind], len(values)) + place
    head = struct.pack(f"{order}2sHHHQ", b"II" if order == "<" else b"MM", 43, 8, 0, pos + len(extra)) if large else struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, pos + len(extra))
    return head + b"".join(body) + extra + struct.pack(f"{order}{'Q' if large else 'H'}", len(fields)) + table + b"\0" * 8


CELLS = (np.random.default_rng(4).standard_normal((11, 13)) * 300).astype(np.float32)
WAYS = [{}, {"order": ">"}, {"large": True}, {"tile": 4}, {"tile": 16, "packing": 8}, {"packing": 5}, {"packing": 8, "predictor": 3}, {"packing": 5, "predictor": 3, "order": ">"}, {"large": True, "order": ">", "tile": 8}]


@pytest.mark.parametrize("way", WAYS, ids=str)
def test_geotiff_of_every_kind(spark, tmp_path, way):
    (tmp_path / "a.tif").write_bytes(_tiff(CELLS, **way))
    rows = geotiff.read_cells(spark, str(tmp_path / "a.tif"), epsg=25832, cell=1, nodata=-9999, bytes_per_task=300).collect()
    assert {(r.row, r.col): r.z for r in rows} == {(i, j): float(CELLS[i, j]) for i in range(11) for j in range(13)} and len(rows) == CELLS.size
    assert {(r.x - r.col, r.y + r.row, r.file) for r in rows} == {(500.0, 900.0, "a.tif")}


def test_lzw_of_long_strips():
    data = bytes(np.random.default_rng(1).integers(0, 7, 60_000, dtype=np.uint8)) + b"\0" * 5000
    assert geotiff.lzw_decode(_lzw(data)) == data and geotiff.lzw_decode(_lzw(b"")) == b""


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    cells = np.arange(200 * 90, dtype=np.float32).reshape(200, 90)
    (tmp_path / "big.tif").write_bytes(geotiff.encode(cells, 0.0, 0.0, deflate=False, rows_per_strip=7))
    (tmp_path / "_left.tif").write_bytes(b"no")
    df = geotiff.read_cells(spark, str(tmp_path), bytes_per_task=10_000)
    assert df.rdd.getNumPartitions() == 8
    assert df.agg(F.sum("z")).first()[0] == cells.sum(dtype=np.float64) and df.select(F.count_distinct("row", "col")).first()[0] == cells.size
    assert geotiff.read_cells(spark, str(tmp_path), bytes_per_task=1 << 20).rdd.getNumPartitions() == 1
    head = geotiff.read_headers(spark, str(tmp_path)).first()
    assert (head.width, head.height, head.bits, head.epsg, head.nodata, head.compression) == (90, 200, 32, 25832, -9999.0, 1)


@pytest.mark.parametrize(
    ("content", "says"),
    [
        (b"PNG....", "a.tif: cut off at byte 7"),
        (b"PNG, surely", "a.tif: not a TIFF file"),
        (_tiff(CELLS)[:200], "a.tif: cut off at byte 200"),
        (_tiff(CELLS, fields={258: ("H", [16])}), "a.tif: expected one sample of 32 bits, got 1 of 16"),
        (_tiff(CELLS, fields={339: ("H", [1])}), "expected floating-point samples, got format 1"),
        (_tiff(CELLS, fields={34735: ("H", [1, 1, 0, 1, 3072, 0, 1, 4326])}), "expected EPSG:25832, got 4326"),
        (_tiff(CELLS, fields={33550: ("d", [2.0, 2.0, 0.0])}), "expected cells of 1 m"),
        (_tiff(CELLS, fields={42113: ("s", b"0\0")}), "expected -9999 for no elevation, got 0.0"),
        (_tiff(CELLS, fields={33922: ("d", [0.0])}), "no tiepoint or cell size"),
        (_tiff(CELLS, fields={259: ("H", [7])}), "compression 7 isn't read"),
        (_tiff(CELLS, fields={278: ("H", [1])}), "11 strips or tiles, but fewer are listed"),
    ],
    ids=lambda x: x[:40] if isinstance(x, str) else None,
)
def test_geotiff_that_is_not_what_it_must_be(spark, tmp_path, content, says):
    (tmp_path / "a.tif").write_bytes(content)
    with pytest.raises(Exception, match=says):
        geotiff.read_cells(spark, str(tmp_path), epsg=25832, cell=1, nodata=-9999).collect()


def _grid(spark, rows=23, columns=31):
    bits = np.random.default_rng(8).integers(0, 1 << 32, rows * columns, dtype=np.uint32)
    z = bits.view(np.float32).copy()
    z[:4] = [np.nan, -0.0, np.inf, -9999.0]
    return z.reshape(rows, columns), spark.createDataFrame(pa.table({"row": np.repeat(np.arange(rows), columns), "col": np.tile(np.arange(columns), rows), "z": z}))


def test_packed_blocks_lose_nothing(spark, tmp_path):
    z, df = _grid(spark)
    assert (grids.unpack(grids.pack(z)).view(np.uint32) == z.view(np.uint32)).all() and grids.pack(z) == grids.pack(z.copy())
    one = grids.write_packed(df.repartition(3), str(tmp_path / "one"), rows=23, columns=31, block=8)
    two = grids.write_packed(df.orderBy(F.desc("col")), f"file://{tmp_path}/two", rows=23, columns=31, block=8)
    assert grids.grid_digest(one).first() == grids.grid_digest(two).first() and one.count() == 12
    back = {(r.row, r.col): np.float32(r.z) for r in grids.read_packed(spark, str(tmp_path / "one")).collect()}
    assert all(np.array(back[i, j]).tobytes() == z[i, j].tobytes() or np.isnan(z[i, j]) and np.isnan(back[i, j]) for i in range(23) for j in range(31)) and len(back) == z.size
    assert files.faults(one, files.contents(spark, str(tmp_path / "one"))).collect() == []
    path = tmp_path / "one" / "b8_16.npz"
    data = bytearray(path.read_bytes())
    data[40] ^= 1
    path.write_bytes(bytes(data))
    with pytest.raises(Exception, match="changed file: b8_16.npz"):
        grids.read_packed(spark, str(tmp_path / "one")).collect()
    path.unlink()
    with pytest.raises(Exception, match="missing file: b8_16.npz"):
        grids.read_packed(spark, str(tmp_path / "one")).collect()
    with pytest.raises(Exception, match="not the planes"):
        grids.unpack(_wrong_planes())


def _wrong_planes():
    out = io.BytesIO()
    np.savez(out, planes=np.zeros((4, 5), np.uint8), shape=np.array([2, 3]))
    return out.getvalue()


def test_grids_with_holes_and_cells_outside(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 1.5), (2, 4, 2.5)], "row int, col int, z double")
    rows = {(r.row, r.col): r.z for r in grids.read_packed(spark, _written(grids.write_packed, df, tmp_path / "a", rows=3, columns=5, block=2)).collect()}
    assert len(rows) == 15 and rows[0, 0] == 1.5 and rows[2, 4] == 2.5 and set(rows.values()) == {1.5, 2.5, -9999.0}
    mosaic = grids.write_mosaic(df, str(tmp_path / "m"), rows=3, columns=5, west=10.0, north=20.0, cell=2.0, block=(2, 2), rows_per_strip=1)
    assert mosaic.count() == 6
    assert {(r.row, r.col): r.z for r in grids.read_mosaic(spark, str(tmp_path / "m"), west=10.0, north=20.0, cell=2.0).collect()} == rows
    with pytest.raises(Exception, match="cell outside a grid of 3 x 5: 3, 0"):
        grids.write_packed(df.union(spark.createDataFrame([(3, 0, 1.0)], df.schema)), str(tmp_path / "b"), rows=3, columns=5)
    with pytest.raises(Exception, match="two rows for one cell"):
        grids.write_packed(df.union(df), str(tmp_path / "c"), rows=3, columns=5)
    assert not (tmp_path / "c" / files.HEAD).exists()
    empty = grids.write_packed(df.limit(0), str(tmp_path / "d"), rows=2, columns=2)
    assert empty.count() == 1 and grids.write_packed(df.limit(0), str(tmp_path / "e"), rows=0, columns=2).count() == 0
    report = {r.rule: r.failures for r in grids.build_report(spark.createDataFrame([(1.0,), (None,), (float("nan"),), (-9999.0,), (700.0,)], "z double"), empty, 0.0, 600.0).collect()}
    assert report == {"finite": 2, "no_nodata": 2, "plausible": 3, "files_hold_bytes": 0}


def _written(write, df, folder, **options):
    write(df, str(folder), **options)
    return str(folder)


def test_a_task_that_runs_twice_leaves_one_file(spark, tmp_path):
    folder = tmp_path / "out"
    batch = pa.RecordBatch.from_pydict({"path": ["x/a.bin", "b.bin"], "content": [b"one", b"two"]})
    writer = files.FileWriter(str(folder))
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    writer.commit([kept, None, files.Written()])
    assert sorted(p.relative_to(folder).as_posix() for p in folder.rglob("*.bin")) == ["b.bin", "x/a.bin"] and lost.part != kept.part
    assert sorted((r.path, r.bytes) for r in files.manifest(spark, str(folder)).collect()) == [("b.bin", 3), ("x/a.bin", 3)]
    assert files.head(str(folder)) == {"files": 2, "bytes": 6, "parts": [kept.part]} and not (folder / files.STAGING).exists()
    with pytest.raises(FileExistsError):
        files.FileWriter(str(folder))
    failed = files.FileWriter(str(tmp_path / "no"))
    failed.abort([failed.write(iter([batch]))])
    assert not (tmp_path / "no" / files.HEAD).exists() and not list((tmp_path / "no").rglob("*.jsonl"))
    for name in ("../a", "/a", "_a", ""):
        with pytest.raises(ValueError, match="not a relative path"):
            writer.write(iter([pa.RecordBatch.from_pydict({"path": [name], "content": [b""]})]))
    with pytest.raises(ValueError, match="two rows for one file"):
        writer.write(iter([batch, batch]))


def test_files_are_what_the_manifest_says(spark, tmp_path):
    rows = [(f"d/{i}.bin", bytes([i] * (i + 1))) for i in range(5)]
    df = spark.createDataFrame(rows, "path string, content binary")
    listed = files.write_files(df.repartition(3), str(tmp_path / "f"))
    assert {(r.path, bytes(r.content)) for r in files.read_files(spark, str(tmp_path / "f")).collect()} == set(rows)
    (tmp_path / "f/d/0.bin").unlink()
    (tmp_path / "f/d/1.bin").write_bytes(b"xx")
    (tmp_path / "f/d/2.bin").write_bytes(b"xx")
    (tmp_path / "f/new.bin").write_bytes(b"xx")
    found = files.contents(spark, str(tmp_path / "f"))
    assert {tuple(r) for r in files.faults(listed.union(listed.filter("path = 'd/3.bin'")), found).collect()} == {("d/0.bin", "missing"), ("d/1.bin", "sha256"), ("d/2.bin", "bytes"), ("d/3.bin", "repeated"), ("new.bin", "unlisted")}
    with pytest.raises(Exception, match="there are files already"):
        files.write_files(df, str(tmp_path / "f"))
    files.write_files(df.limit(1), str(tmp_path / "f"), overwrite=True)
    assert files.manifest(spark, str(tmp_path / "f")).count() == 1


def _png(rgb, row_filter):
    h, w, _ = rgb.shape
    before = np.zeros_like(rgb)
    if row_filter == 1:
        before[:, 1:] = rgb[:, :-1]
    elif row_filter == 2:
        before[1:] = rgb[:-1]
    lines = np.concatenate([np.full((h, 1), row_filter, np.uint8), (rgb - before).reshape(h, -1)], axis=1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    data = zlib.compress(lines.tobytes())
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"tEXt", b"a") + chunk(b"IDAT", data[:9]) + chunk(b"IDAT", data[9:]) + chunk(b"IEND", b"")


def test_images():
    rgb = np.random.default_rng(2).integers(0, 256, (7, 5, 3), dtype=np.uint8)
    for content in (grids.encode_png(rgb), _png(rgb, 0), _png(rgb, 1), _png(rgb, 2)):
        width, height, mode, pixels = grids.decode_png(content)
        assert (width, height, mode) == (5, 7, "RGB") and (pixels == rgb).all()
    good = grids.encode_png(rgb)
    for bad in (good[:-1], good + b"x", good[:30] + bytes([good[30] ^ 1]) + good[31:], b"", good[:8], _png(rgb, 4)):
        with pytest.raises((ValueError, struct.error)):
            grids.decode_png(bad)
    gray, large = grids.odd_images(8)
    assert grids.decode_png(gray)[2:] == ("L", None) and grids.decode_png(large)[:2] == (16, 16)
    z = np.array([[-32768.0, 0.0, 8848.4], [0.001953125, 0.005859375, 32767.996]])
    code = grids.terrarium_rgb(z).astype(int) @ [65536, 256, 1]
    assert code.tolist() == [[0, 8388608, 10653798], [8388608, 8388610, 16777215]]
    with pytest.raises(ValueError, match="range"):
        grids.terrarium_rgb(np.array([32768.0]))


def test_the_gate_of_tiles(spark, tmp_path):
    pixels = spark.range(2 * 16).selectExpr("12 zoom", "id div 16 x", "7 y", "id % 16 div 4 row", "id % 4 column", "id * 1.37 z")
    folder = str(tmp_path / "t")
    listed = grids.write_files_of_tiles(pixels, folder, 4)
    assert sorted(p.relative_to(tmp_path / "t").as_posix() for p in pathlib.Path(folder).rglob("*.png")) == ["12/0/7.png", "12/1/7.png"]
    fails = lambda **o: {r.rule: r.failures for r in grids.tile_gate(listed, files.contents(spark, folder), **({"size": 4, "source": pixels} | o)).collect() if not r.ok}
    assert fails() == {}
    assert fails(size=8, source=None) == {"size": 2} and fails(most_bytes=50) == {"budget": 1}
    assert fails(source=pixels.withColumn("z", F.col("z") + 0.01)) == {"quantum": 32}
    with pytest.raises(Exception, match="tile 12/1/7 has 15 pixels of 16"):
        grids.tile_files(pixels.filter("not (x = 1 and row = 2 and column = 3)"), 4).collect()
    with pytest.raises(Exception, match="outside the encoding's range"):
        grids.tile_files(pixels.withColumn("z", F.lit(40000.0)), 4).collect()
