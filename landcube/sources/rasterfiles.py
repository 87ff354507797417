"""Raster files as bytes: where each piece of an array lies in its file, and how a piece is read and written.

``.npy`` arrays of two or three dimensions, TIFF (strips or tiles, plain or deflate, interleaved or by plane, with the place on
the ground) and PNG (without interlacing). A :class:`Layout` is made from a file's first bytes; its pieces are read one by one,
so that a task needs only the pieces of its own rows.
"""

from __future__ import annotations

import ast
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np

#: Reads ``size`` bytes at an offset.
Reader = Callable[[int, int], bytes]
#: Bytes of a piece of an array whose format doesn't divide it.
PIECE_BYTES = 4_000_000


@dataclass(frozen=True)
class Piece:
    """Rows and columns of one band, or of all bands pixel by pixel (``band`` is None), that are stored together."""

    band: int | None
    row: int
    rows: int
    column: int
    columns: int
    offset: int
    size: int


@dataclass(frozen=True)
class Layout:
    """An image's form and where its pieces lie, by row, column and band. ``ground``: west and north of the first
    pixel's corner, pixel width and height, and the EPSG code, where the file has them."""

    kind: str
    bands: int
    rows: int
    columns: int
    dtype: str
    pieces: tuple[Piece, ...]
    deflate: bool = False
    predictor: int = 1
    ground: tuple[float, float, float, float, int | None] | None = None
    palette: bytes = field(default=b"", repr=False)

    def row_pieces(self, low: int, high: int) -> list[Piece]:
        """The pieces with rows in low .. high - 1; an undivided array's are cut to just these."""
        own = [p for p in self.pieces if p.row < high and p.row + p.rows > low]
        if self.kind != "npy":
            return own
        cut = []
        for p in own:
            first, end, width = max(low, p.row), min(high, p.row + p.rows), p.size // p.rows
            cut.append(replace(p, row=first, rows=end - first, offset=p.offset + (first - p.row) * width, size=(end - first) * width))
        return cut


def layout(read: Reader, size: int) -> Layout:
    """ValueError if the bytes are none of the formats, or of a form that isn't read."""
    head = read(0, min(size, 16))
    try:
        if head[:6] == b"\x93NUMPY":
            return _npy(read, size)
        if head[:4] in (b"II*\0", b"MM\0*"):
            return _tiff(read, size)
        if head[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(read, size)
    except (struct.error, KeyError, IndexError, SyntaxError, TypeError, OverflowError) as e:
        raise ValueError(f"a raster file with a broken head: {e}") from e
    raise ValueError("neither .npy, TIFF nor PNG")


def _npy(read: Reader, size: int) -> Layout:
    major = read(6, 1)[0]
    wide = 2 if major == 1 else 4
    length = int.from_bytes(read(8, wide), "little")
    head = ast.literal_eval(read(8 + wide, length).decode("latin-1").strip())
    shape, dtype = head["shape"], np.dtype(head["descr"])
    if len(shape) not in (2, 3) or head["fortran_order"] or dtype.kind not in "biuf":
        raise ValueError(f"an array of shape {shape} and kind {dtype}, or in column order")
    bands, rows, columns = (1, *shape)[-3:]
    start, width = 8 + wide + length, columns * dtype.itemsize
    if start + bands * rows * width > size:
        raise ValueError("an array that is cut off")
    step = max(1, PIECE_BYTES // max(1, width))
    pieces = [Piece(b, r, min(step, rows - r), 0, columns, start + (b * rows + r) * width, min(step, rows - r) * width) for r in range(0, rows, step) for b in range(bands)]
    return Layout("npy", bands, rows, columns, dtype.str, tuple(pieces) if columns else ())


# Bytes of the TIFF field types, and the tags that are read.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_SIZES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT, SCALE, TIE, GEO_KEYS = 284, 317, 322, 323, 324, 325, 339, 33550, 33922, 34735


def _tiff(read: Reader, size: int) -> Layout:
    head = read(0, 8)
    end = "<" if head[:2] == b"II" else ">"
    (at,) = struct.unpack(end + "I", head[4:])
    (n,) = struct.unpack(end + "H", read(at, 2))
    tags = {}
    for k in range(n):
        entry = read(at + 2 + 12 * k, 12)
        tag, kind, count = struct.unpack(end + "HHI", entry[:8])
        if kind not in _CODES:
            continue
        bytes_ = _SIZES[kind] * count
        data = entry[8 : 8 + bytes_] if bytes_ <= 4 else read(struct.unpack(end + "I", entry[8:])[0], bytes_)
        tags[tag] = struct.unpack(f"{end}{count}{_CODES[kind]}", data)
    first = lambda tag, default: tags.get(tag, (default,))[0]
    columns, rows, bands = tags[WIDTH][0], tags[HEIGHT][0], first(SAMPLES, 1)
    bits, form = set(tags.get(BITS, (1,))), set(tags.get(FORMAT, (1,)))
    kinds = {1: "u", 2: "i", 3: "f"}
    if len(bits) > 1 or len(form) > 1 or min(bits) not in (8, 16, 32, 64) or min(form) not in kinds or first(COMPRESSION, 1) not in (1, 8, 32946) or first(PREDICTOR, 1) not in (1, 2):
        raise ValueError(f"a TIFF with {bits} bits, format {form}, compression {first(COMPRESSION, 1)}, predictor {first(PREDICTOR, 1)}")
    dtype = np.dtype(f"{end}{kinds[min(form)]}{min(bits) // 8}").str
    planes = bands if first(PLANAR, 1) == 2 else 1
    if TILES in tags:
        wide, high, offsets, counts = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0], tags[TILES], tags[TILE_SIZES]
    else:
        wide, high, offsets, counts = columns, min(first(STRIP_ROWS, rows), rows), tags[STRIPS], tags[STRIP_SIZES]
    across, down = -(-columns // wide), -(-rows // high)
    pieces = []
    for k in range(planes * down * across):
        plane, y, x = k // (down * across), k // across % down, k % across
        if offsets[k] + counts[k] > size:
            raise ValueError("a TIFF that is cut off")
        stored = high if TILES in tags else min(high, rows - y * high)
        pieces.append(Piece(plane if planes > 1 or bands == 1 else None, y * high, stored, x * wide, wide, offsets[k], counts[k]))
    ground = None
    if SCALE in tags and TIE in tags:
        (dx, dy, *_), (i, j, _, x, y, *_) = tags[SCALE], tags[TIE]
        keys = tags.get(GEO_KEYS, ())
        codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
        # the code of a projection, or else of a geographic system (fixed values)
        ground = (x - i * dx, y + j * dy, dx, dy, codes.get(3072, codes.get(2048)))
    return Layout("tiff", bands, rows, columns, dtype, tuple(sorted(pieces, key=lambda p: (p.row, p.column, p.band or 0))), first(COMPRESSION, 1) != 1, first(PREDICTOR, 1), ground)


def _png(read: Reader, size: int) -> Layout:
    at, data, palette, head = 8, [], b"", None
    while at + 8 <= size:
        length, kind = struct.unpack(">I4s", read(at, 8))
        if at + 12 + length > size:
            raise ValueError("a PNG that is cut off")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", read(at + 8, 13))
        elif kind == b"PLTE":
            palette = read(at + 8, length)
        elif kind == b"IDAT":
            data.append((at + 8, length))
        elif kind == b"IEND":
            break
        at += 12 + length
    if head is None or not data:
        raise ValueError("a PNG without a head or without data")
    columns, rows, bits, colour, _, _, interlaced = head
    stored = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if stored is None or bits not in (8, 16) or interlaced or (colour == 3 and bits != 8):
        raise ValueError(f"a PNG of {bits} bits, colour type {colour}, interlacing {interlaced}")
    first, last = data[0][0] - 8, data[-1][0] + data[-1][1]
    bands = 3 if colour == 3 else stored
    return Layout("png", bands, rows, columns, ">u2" if bits == 16 else "|u1", (Piece(None, 0, rows, 0, columns, first, last - first),), True, palette=palette)


def values(at: Layout, piece: Piece, data: bytes, last: int | None = None) -> np.ndarray:
    """A piece as an array (bands, rows, columns) within the image. ``last``: a PNG's rows beyond it need not be there."""
    dtype = np.dtype(at.dtype)
    if at.kind == "png":
        return _png_values(at, data, at.rows if last is None else min(at.rows, last + 1))
    bands = at.bands if piece.band is None else 1
    if at.deflate:
        data = zlib.decompress(data)
    x = np.frombuffer(data, dtype, piece.rows * piece.columns * bands).reshape(piece.rows, piece.columns, bands)
    if at.predictor == 2:
        x = np.add.accumulate(x, axis=1, dtype=dtype.newbyteorder("="))
    return x[: at.rows - piece.row, : at.columns - piece.column].transpose(2, 0, 1)


def _png_values(at: Layout, data: bytes, rows: int) -> np.ndarray:
    """The first ``rows`` rows. ``data`` runs from the first IDAT chunk to the last."""
    item = np.dtype(at.dtype).itemsize
    pixel = item * (1 if at.palette else at.bands)
    width = 1 + pixel * at.columns
    unpack, raw = zlib.decompressobj(), bytearray()
    for part in _idat(data):
        raw += unpack.decompress(part, max(0, width * rows - len(raw)))
        if len(raw) >= width * rows:
            break
    if len(raw) < width * rows:
        raise ValueError("a PNG that is cut off")
    lines = np.frombuffer(bytes(raw), np.uint8).reshape(rows, width)
    out, above = np.zeros((rows, width - 1), np.uint8), np.zeros(width - 1, np.uint8)
    for k in range(rows):
        above = out[k] = _unfiltered(int(lines[k, 0]), lines[k, 1:], above, pixel)
    if at.palette:
        return np.frombuffer(at.palette, np.uint8).reshape(-1, 3)[out].transpose(2, 0, 1)
    return out.view(at.dtype).reshape(rows, at.columns, at.bands).transpose(2, 0, 1)


def _idat(data: bytes):
    """The contents of the IDAT chunks, each behind its length and name and before its checksum."""
    at = 0
    while at + 8 <= len(data):
        length, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            yield data[at + 8 : at + 8 + length]
        at += 12 + length


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, pixel: int) -> np.ndarray:
    """A row of bytes from its differences to the pixel before, the row above, or both (the five kinds of PNG)."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    by_pixel = line.reshape(-1, pixel)
    if kind == 1:
        return np.add.accumulate(by_pixel, axis=0, dtype=np.uint8).ravel()
    if kind not in (3, 4):
        raise ValueError(f"PNG filter {kind}")
    out = line.astype(np.int64).tolist()
    up = above.tolist()
    for i in range(len(out)):
        left, corner = (out[i - pixel], up[i - pixel]) if i >= pixel else (0, 0)
        if kind == 3:
            guess = (left + up[i]) // 2
        else:
            # the one of left, above and corner that is nearest to left + above - corner
            a, b, c = abs(up[i] - corner), abs(left - corner), abs(left + up[i] - 2 * corner)
            guess = left if a <= b and a <= c else up[i] if b <= c else corner
        out[i] = (out[i] + guess) & 255
    return np.array(out, np.uint8)


def npy_bytes(x: np.ndarray) -> bytes:
    from io import BytesIO

    made = BytesIO()
    np.save(made, np.ascontiguousarray(x), allow_pickle=False)
    return made.getvalue()


def tiff_bytes(x: np.ndarray, deflate: bool = True, strip: int = 64, ground: tuple[float, float, float, float, int] | None = None) -> bytes:
    """(bands, rows, columns) as a little-endian TIFF in strips, its bands pixel by pixel."""
    x = np.atleast_3d(x.T).T if x.ndim == 2 else x
    bands, rows, columns = x.shape
    x = np.ascontiguousarray(x.transpose(1, 2, 0).astype(x.dtype.newbyteorder("<")))
    strips = [x[r : r + strip].tobytes() for r in range(0, rows, strip)]
    strips = [zlib.compress(s) for s in strips] if deflate else strips
    offsets = np.cumsum([8, *map(len, strips)]).tolist()
    short, long, double = 3, 4, 12
    tags = [
        (WIDTH, long, [columns]), (HEIGHT, long, [rows]), (BITS, short, [x.dtype.itemsize * 8] * bands), (COMPRESSION, short, [8 if deflate else 1]), (PHOTOMETRIC, short, [1]), (STRIPS, long, offsets[:-1]), (SAMPLES, short, [bands]),
        (STRIP_ROWS, long, [strip]), (STRIP_SIZES, long, list(map(len, strips))), (PLANAR, short, [1]), (FORMAT, short, [{"u": 1, "i": 2, "f": 3}[x.dtype.kind]] * bands),
    ]
    if ground:
        west, north, dx, dy, code = ground
        tags += [(SCALE, double, [dx, dy, 0.0]), (TIE, double, [0.0, 0.0, 0.0, west, north, 0.0]), (GEO_KEYS, short, [1, 1, 0, 1, 3072, 0, 1, code])]
    head, body, at = b"", b"", offsets[-1] + 2 + 12 * len(tags) + 4
    for tag, kind, own in tags:
        data = struct.pack(f"<{len(own)}{_CODES[kind]}", *own)
        head += struct.pack("<HHI", tag, kind, len(own)) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", at + len(body)))
        body += data if len(data) > 4 else b""
    return b"II*\0" + struct.pack("<I", offsets[-1]) + b"".join(strips) + struct.pack("<H", len(tags)) + head + b"\0\0\0\0" + body


def png_bytes(x: np.ndarray) -> bytes:
    """(bands, rows, columns) of 8 or 16 bits with one to four bands as a PNG; every row is stored as it is."""
    x = x[None] if x.ndim == 2 else x
    bands, rows, columns = x.shape
    bits = x.dtype.itemsize * 8
    lines = np.ascontiguousarray(x.transpose(1, 2, 0).astype(x.dtype.newbyteorder(">"))).view(np.uint8).reshape(rows, -1)
    raw = np.concatenate([np.zeros((rows, 1), np.uint8), lines], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", columns, rows, bits, {1: 0, 2: 4, 3: 2, 4: 6}[bands], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


ENCODERS: dict[str, Callable[[np.ndarray], bytes]] = {"npy": npy_bytes, "tif": tiff_bytes, "png": png_bytes}
