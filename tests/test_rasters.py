"""The raster data source against plain arrays, in every form that it reads."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from landcube.sources import raster, rasterfiles, rastersource


def put(folder, name, data):
    (folder / name).write_bytes(data)
    return str(folder / name)


def array_of(df, shape):
    out = np.full(shape, np.nan)
    for x in df.collect():
        out[x["band"], x["r"], x["c"]] = x["value"]
    return out


def image(shape, dtype, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=shape).astype(dtype) if np.dtype(dtype).kind == "f" else rng.integers(0, 200, shape).astype(dtype)


def filtered_png(x, chunk=37):
    """A PNG whose rows use all five filters in turn, its data in many chunks."""
    bands, rows, columns = x.shape
    lines = np.ascontiguousarray(x.transpose(1, 2, 0).astype(x.dtype.newbyteorder(">"))).view(np.uint8).reshape(rows, -1).astype(int)
    step = bands * x.dtype.itemsize
    raw = b""
    for k in range(rows):
        own, up = lines[k], lines[k - 1] if k else np.zeros_like(lines[k])
        left, corner = np.r_[np.zeros(step, int), own[:-step]], np.r_[np.zeros(step, int), up[:-step]]
        near = left + up - corner
        paeth = [min(((abs(n - a), 0, a), (abs(n - b), 1, b), (abs(n - c), 2, c)))[2] for n, a, b, c in zip(near, left, up, corner, strict=True)]
        guess = [0 * own, left, up, (left + up) // 2, np.array(paeth)][k % 5]
        raw += bytes([k % 5]) + ((own - guess) % 256).astype(np.uint8).tobytes()
    piece = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    data = zlib.compress(raw)
    head = struct.pack(">IIBBBBB", columns, rows, x.dtype.itemsize * 8, {1: 0, 2: 4, 3: 2, 4: 6}[bands], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + piece(b"IHDR", head) + piece(b"tEXt", b"k\0v") + b"".join(piece(b"IDAT", data[i : i + chunk]) for i in range(0, len(data), chunk)) + piece(b"IEND", b"")


def tiled_tiff(x, tile, planar, predictor, end=">"):
    """A big-endian TIFF in tiles, deflated, by plane or by pixel, with differences along rows."""
    bands, rows, columns = x.shape
    code = {"u": 1, "i": 2, "f": 3}[x.dtype.kind]
    tiles = []
    for plane in [[b] for b in range(bands)] if planar == 2 else [list(range(bands))]:
        for r in range(0, rows, tile):
            for c in range(0, columns, tile):
                own = np.zeros((tile, tile, len(plane)), x.dtype)
                part = x[plane, r : r + tile, c : c + tile].transpose(1, 2, 0)
                own[: part.shape[0], : part.shape[1]] = part
                if predictor == 2:
                    own = np.diff(own, axis=1, prepend=np.zeros((tile, 1, len(plane)), x.dtype))
                tiles.append(zlib.compress(own.astype(x.dtype.newbyteorder(end)).tobytes()))
    offsets = np.cumsum([8, *map(len, tiles)]).tolist()
    tags = [(256, 3, [columns]), (257, 3, [rows]), (258, 3, [x.dtype.itemsize * 8] * bands), (259, 3, [32946]), (277, 3, [bands]), (284, 3, [planar]), (317, 3, [predictor]), (322, 3, [tile]), (323, 3, [tile]), (324, 4, offsets[:-1]), (325, 4, list(map(len, tiles))), (339, 3, [code] * bands)]
    head, body, at = b"", b"", offsets[-1] + 2 + 12 * len(tags) + 4
    for tag, kind, own in tags:
        data = struct.pack(f"{end}{len(own)}{'H' if kind == 3 else 'I'}", *own)
        head += struct.pack(end + "HHI", tag, kind, len(own)) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(end + "I", at + len(body)))
        body += data if len(data) > 4 else b""
    return b"MM\0*" + struct.pack(end + "I", offsets[-1]) + b"".join(tiles) + struct.pack(end + "H", len(tags)) + head + b"\0\0\0\0" + body


FORMS = {
    "2d.npy": (image((1, 9, 7), "<f4"), lambda x: rasterfiles.npy_bytes(x[0])), "3d.npy": (image((3, 9, 7), ">i2"), rasterfiles.npy_bytes), "bool.npy": (image((1, 5, 5), "bool"), rasterfiles.npy_bytes), "strips.tif": (image((3, 70, 11), "<u2"), lambda x: rasterfiles.tiff_bytes(x, True, 16)),
    "plain.tif": (image((1, 20, 11), "<f8"), lambda x: rasterfiles.tiff_bytes(x, False, 7)), "tiles.tif": (image((3, 37, 21), "u1"), lambda x: tiled_tiff(x, 16, 1, 2)), "planes.tif": (image((2, 37, 21), "u2"), lambda x: tiled_tiff(x, 16, 2, 2)), "float.tif": (image((1, 18, 5), "f4"), lambda x: tiled_tiff(x, 16, 1, 1)),
    "rgb.png": (image((3, 12, 9), "u1"), rasterfiles.png_bytes), "rgba.png": (image((4, 11, 9), "u1"), filtered_png), "grey16.png": (image((1, 11, 9), "u2") * 300, filtered_png),
}


@pytest.mark.parametrize("name", FORMS)
def test_forms(spark, tmp_path, name):
    x, encode = FORMS[name]
    put(tmp_path, name, encode(x))
    assert np.array_equal(array_of(rastersource.cells(spark, str(tmp_path)), x.shape), x.astype(float))
    low = rastersource.cells(spark, str(tmp_path)).where("r >= 3 and r < 8 and band = 0")
    assert {(r["r"], r["c"]): r["value"] for r in low.collect()} == {(r, c): float(x[0, r, c]) for r in range(3, min(8, x.shape[1])) for c in range(x.shape[2])}
    wide = rastersource.cells(spark, str(tmp_path), wide="4").collect()
    assert len(wide) == x[0].size and all([r[f"b{i}"] for i in range(4)] == [float(v) for v in x[:, r["r"], r["c"]]] + [None] * (4 - len(x)) for r in wide)


def test_large_array_is_many_tasks_and_rows_skip_bytes(spark, tmp_path, monkeypatch):
    x = np.arange(4000 * 600, dtype="<f4").reshape(4000, 600)
    put(tmp_path, "large.npy", rasterfiles.npy_bytes(x))
    monkeypatch.setattr(rasterfiles, "PIECE_BYTES", 100_000)
    read = []

    def count(reader):
        parts = reader.partitions()
        read.append(sum(p.size for part in parts for path, n in part.files for g in reader.groups(rastersource.layout_of(path, n), part.share, part.shares) for p in g))
        return parts

    options = {"path": str(tmp_path), "partbytes": "500000"}
    assert len(count(rastersource.Reader(options))) == 20 and read[-1] == x.nbytes
    few = rastersource.Reader(options)
    assert list(few.pushFilters([GreaterThanOrEqual(("r",), 1000), LessThan(("r",), 1010), EqualTo(("c",), 3)])) == [EqualTo(("c",), 3)]
    count(few)
    assert read[-1] == 10 * 600 * 4
    got = [b.to_pydict() for part in few.partitions() for b in few.read(part)]
    assert sorted(v for b in got for v in b["value"]) == x[1000:1010].ravel().tolist()
    none = rastersource.Reader(options)
    list(none.pushFilters([In(("name",), ("other.npy",))]))
    assert none.partitions() == []
    df = rastersource.cells(spark, str(tmp_path), partbytes="500000").where("r >= 1000 and r < 1010")
    assert df.agg(F.count("*"), F.sum("value")).first() == (6000, float(x[1000:1010].astype(float).sum()))
    assert df.rdd.getNumPartitions() == 20


def test_unreadable_files(spark, tmp_path):
    x = image((2, 6, 5), "u1")
    put(tmp_path, "a.npy", rasterfiles.npy_bytes(x))
    whole = rasterfiles.tiff_bytes(x, ground=(77.5, 13.0, 0.5, 0.25, 32643))
    put(tmp_path, "b.tif", whole)
    put(tmp_path, "c.npy", b"\x93NUMPY\x01\x00")
    put(tmp_path, "d.png", filtered_png(x)[:60])
    put(tmp_path, "e.txt", b"")
    put(tmp_path, "f.tif", whole[:30])
    rows = {r["name"]: r for r in rastersource.info(spark, str(tmp_path)).collect()}
    assert [n for n, r in sorted(rows.items()) if r["error"] is None] == ["a.npy", "b.tif"]
    b = rows["b.tif"]
    assert (b["bands"], b["rows"], b["columns"], b["west"], b["north"], b["pixel_width"], b["pixel_height"], b["epsg"]) == (2, 6, 5, 77.5, 13.0, 0.5, 0.25, 32643)
    assert rastersource.cells(spark, str(tmp_path), unreadable="skip").groupBy("name").count().count() == 2
    with pytest.raises(Exception, match="neither .npy, TIFF nor PNG"):
        rastersource.cells(spark, str(tmp_path), "e*").count()


def test_band_by_its_first_ending(spark, tmp_path):
    x = image((1, 8, 6), "u2")
    put(tmp_path, "B04.tiff", rasterfiles.tiff_bytes(x))
    put(tmp_path, "B04.TIF", rasterfiles.tiff_bytes(x + 1))
    assert np.array_equal(array_of(raster.band_cells(spark, str(tmp_path), "B04"), x.shape), x.astype(float))
    with pytest.raises(FileNotFoundError):
        raster.band_cells(spark, str(tmp_path), "B08")


@pytest.mark.parametrize("encode", [filtered_png, rasterfiles.tiff_bytes])
def test_year_scene_of_four_channels(spark, tmp_path, encode):
    x = image((4, 7, 5), "u1")
    x[3] %= 12
    put(tmp_path, "scene", encode(x))
    for r in raster.year_scene(spark, str(tmp_path / "scene")).collect():
        u8 = x[:, r["r"], r["c"]]
        assert [r["ndvi"], r["ndbi"], r["ndwi"]] == pytest.approx([v / 127.5 - 1 for v in u8[:3].tolist()])
        assert r["valid"] == (u8[3] in (2, 4, 5, 6, 7, 11))


def test_images_as_rgb(spark, tmp_path):
    grey, colour = image((1, 4, 5), "u1"), image((4, 4, 5), "u1", 2)
    put(tmp_path, "grey.png", rasterfiles.png_bytes(grey))
    put(tmp_path, "colour.png", rasterfiles.png_bytes(colour))
    for r in raster.rgb_images(spark, str(tmp_path)).collect():
        x = grey[[0, 0, 0]] if r["name"] == "grey.png" else colour[:3]
        assert [r["red"], r["green"], r["blue"]] == x[:, r["r"], r["c"]].tolist()
