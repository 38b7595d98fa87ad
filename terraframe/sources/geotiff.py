"""TIFF directories, GeoTIFF keys, blocks and their decoding.

A file is read by ranges: the directories, and then the blocks that are asked for. Samples of 1, 2, 4, 8 and 16 bits, chunky or in planes,
without compression or with Deflate, LZW or PackBits, as gray, RGB, palette, CMYK and YCbCr without subsampling, become RGBA. Floating-point and wider
samples have no colours of their own and are refused, as are blocks compressed by JPEG.
"""

from __future__ import annotations

import math
import struct
import zlib
from dataclasses import dataclass

from .geometry import Malformed, Unsupported

#: Tags that are read.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, ORIENTATION, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 274, 277, 278, 279
PLANAR, PREDICTOR, COLORMAP, TILE_W, TILE_H, TILES, TILE_BYTES, FORMAT, SUBSAMPLING = 284, 317, 320, 322, 323, 324, 325, 339, 530
SCALE, TIEPOINT, MATRIX, GEOKEYS, GEODOUBLES, GEOASCII, NODATA = 33550, 33922, 34264, 34735, 34736, 34737, 42113
#: Tag types as struct formats.
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
#: Keys of the GeoKey directory.
RASTER_TYPE, GEOGRAPHIC, GEOGRAPHIC_NAME, PROJECTED, PROJECTED_NAME = 1025, 2048, 2049, 3072, 3073


class Cancelled(Exception):
    """Nobody waits for the read any more."""


@dataclass(frozen=True)
class Directory:
    tags: dict
    order: str

    def one(self, tag: int, default=None):
        v = self.tags.get(tag)
        return default if not v else v[0]

    @property
    def size(self) -> tuple[int, int]:
        return self.one(WIDTH), self.one(HEIGHT)

    @property
    def tiled(self) -> bool:
        return TILE_W in self.tags

    @property
    def block(self) -> tuple[int, int]:
        w, h = self.size
        return (self.one(TILE_W), self.one(TILE_H)) if self.tiled else (w, min(h, self.one(STRIP_ROWS, h)))

    @property
    def planes(self) -> int:
        """Planes that samples lie in: one unless each has its own."""
        return self.one(SAMPLES, 1) if self.one(PLANAR, 1) == 2 else 1

    def places(self, number: int) -> list[tuple[int, int]]:
        """(offset, length) of a block in the file, for each plane."""
        offsets, lengths = (self.tags[TILES], self.tags[TILE_BYTES]) if self.tiled else (self.tags[STRIPS], self.tags[STRIP_BYTES])
        each = len(offsets) // self.planes
        return [(offsets[p * each + number], lengths[p * each + number]) for p in range(self.planes)]

    def slim(self) -> Directory:
        """Without the places of the blocks, of which there may be very many."""
        return Directory({k: v for k, v in self.tags.items() if k not in (TILES, TILE_BYTES, STRIPS, STRIP_BYTES)}, self.order)


class Pages:
    """Bytes of a file by ranges, read in pages that are kept; ``fetch(offset, length)`` may return less at the end of the file."""

    SIZE = 1 << 14

    def __init__(self, fetch) -> None:
        self.fetch, self.pages = fetch, {}

    def read(self, offset: int, length: int) -> bytes:
        if length > self.SIZE:
            out = self.fetch(offset, length)
        else:
            first, last = offset // self.SIZE, (offset + max(1, length) - 1) // self.SIZE
            for k in range(first, last + 1):
                if k not in self.pages:
                    self.pages[k] = self.fetch(k * self.SIZE, self.SIZE)
            both = b"".join(self.pages[k] for k in range(first, last + 1))
            out = both[offset - first * self.SIZE : offset - first * self.SIZE + length]
        if len(out) < length:
            raise Malformed("a TIFF directory or tag is truncated")
        return out


def directories(fetch) -> list[Directory]:
    """All image directories of a TIFF or BigTIFF, in file order; ``fetch(offset, length)`` reads the file, or it is the file's bytes."""
    if isinstance(fetch, bytes):
        data = fetch
        fetch = lambda offset, length: data[offset : offset + length]
    head = fetch(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8:
        raise Malformed("not a TIFF")
    magic = struct.unpack_from(order + "H", head, 2)[0]
    big = magic == 43
    if magic not in (42, 43):
        raise Malformed("not a TIFF")
    word, count, entry, inline = ("Q", "Q", 20, 8) if big else ("I", "H", 12, 4)
    pages = Pages(fetch)

    def at(form: str, offset: int):
        return struct.unpack(order + form, pages.read(offset, struct.calcsize(order + form)))

    (offset,) = at(word, 8 if big else 4)
    out, seen = [], set()
    while offset:
        if offset in seen:
            raise Malformed("TIFF directories form a loop")
        seen.add(offset)
        (n,) = at(count, offset)
        base, tags = offset + struct.calcsize(order + count), {}
        for i in range(n):
            here = base + i * entry
            tag, kind = at("HH", here)
            (items,) = at(word, here + 4)
            form = TYPES.get(kind)
            if form is None:
                continue
            total = struct.calcsize(order + form) * items
            place = here + 4 + struct.calcsize(word) if total <= inline else at(word, here + 4 + struct.calcsize(word))[0]
            raw = pages.read(place, total)
            if kind == 2:
                tags[tag] = (raw.decode("latin-1"),)
            else:
                tags[tag] = struct.unpack(order + form * items if len(form) > 1 else f"{order}{items}{form}", raw)
        d = Directory(tags, order)
        if d.one(ORIENTATION, 1) != 1:
            raise Unsupported("TIFF orientations other than the first")
        out.append(d)
        (offset,) = at(word, base + n * entry)
    if not out:
        raise Malformed("a TIFF without images")
    return out


def geokeys(d: Directory) -> dict[int, object]:
    """GeoKey -> number or text. Codes must lie in the directory itself, one each."""
    raw = d.tags.get(GEOKEYS, ())
    out: dict[int, object] = {}
    for i in range(4, len(raw) - 3, 4):
        key, place, count, v = raw[i : i + 4]
        if place == 0 and count == 1:
            out[key] = v
        elif place == GEOASCII:
            out[key] = d.tags.get(GEOASCII, ("",))[0][v : v + count].rstrip("|\0")
        elif place == GEODOUBLES and count:
            out[key] = d.tags.get(GEODOUBLES, ())[v]
    return out


def overviews(all_: list[Directory]) -> list[tuple[int, int, int, float, float]]:
    """(directory number, width, height, decimations) of directories smaller than the first on both axes."""
    w, h = all_[0].size
    return [(i, *d.size, w / d.size[0], h / d.size[1]) for i, d in enumerate(all_) if i and d.size[0] < w and d.size[1] < h]


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes from the high bit, the width grows one code early."""
    out, table, width, buffer, held, last = bytearray(), [], 9, 0, 0, None
    for byte in data:
        buffer, held = buffer << 8 | byte, held + 8
        while held >= width:
            held -= width
            code = buffer >> held & (1 << width) - 1
            buffer &= (1 << held) - 1
            if code == 256:
                table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
                continue
            if code == 257:
                return bytes(out)
            if last is None:
                found = table[code]
            elif code < len(table):
                found = table[code]
                table.append(last + found[:1])
            elif code == len(table):
                found = last + last[:1]
                table.append(found)
            else:
                raise Malformed("LZW data has an unknown code")
            out += found
            last = found
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
    return bytes(out)


def packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def unpacked(data: bytes, compression: int) -> bytes:
    if compression == 1:
        return data
    if compression in (8, 32946):
        return zlib.decompress(data)
    if compression == 5:
        return lzw(data)
    if compression == 32773:
        return packbits(data)
    raise Unsupported(f"TIFF compression {compression}")


def samples(d: Directory, raw: bytes, w: int, h: int, n: int):
    """Samples (h, w, n) of the bytes of a block in one plane, as they are written."""
    import numpy as np

    bits = set(d.tags.get(BITS, (1,)))
    if len(bits) != 1 or (bits := bits.pop()) not in (1, 2, 4, 8, 16) or d.one(FORMAT, 1) not in (1, 4):
        raise Unsupported("TIFF samples that aren't whole numbers of up to 16 bits")
    row = -(-w * n * bits // 8)
    if len(raw) < row * h:
        raise Malformed("a TIFF block is truncated")
    if bits == 16:
        a = np.frombuffer(raw, d.order + "u2", h * w * n).reshape(h, w, n)
    elif bits == 8:
        a = np.frombuffer(raw, np.uint8, h * w * n).reshape(h, w, n)
    else:
        each = np.unpackbits(np.frombuffer(raw, np.uint8, row * h).reshape(h, row), axis=1)[:, : w * n * bits].reshape(h, w, n, bits)
        a = (each << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=3, dtype=np.uint8)
    if d.one(PREDICTOR, 1) == 2:
        a = np.cumsum(a, axis=1, dtype=np.uint16 if bits == 16 else np.uint8)
    elif d.one(PREDICTOR, 1) != 1:
        raise Unsupported("TIFF predictors of floating-point samples")
    return a


def rgba(d: Directory, planes: list[bytes], w: int, h: int):
    """Pixels (h, w, 4) of a block's bytes, one for each plane."""
    import numpy as np

    n, photometric, bits = d.one(SAMPLES, 1), d.one(PHOTOMETRIC, 1), d.one(BITS, 1)
    a = np.dstack([samples(d, p, w, h, 1) for p in planes]) if d.planes > 1 else samples(d, planes[0], w, h, n)
    full = (1 << bits) - 1
    # 16 bits by their upper half, fewer than 8 stretched
    eight = lambda v: (v >> 8 if bits == 16 else v if bits == 8 else v.astype(np.uint16) * 255 // full).astype(np.uint8)
    out = np.full((h, w, 4), 255, np.uint8)
    if photometric in (0, 1):
        out[..., :3] = eight(full - a[..., :1] if photometric == 0 else a[..., :1])
        if n > 1:
            out[..., 3] = eight(a[..., 1])
    elif photometric == 2 and n >= 3:
        out[..., :3] = eight(a[..., :3])
        if n > 3:
            out[..., 3] = eight(a[..., 3])
    elif photometric == 3 and bits <= 8:
        table = np.array(d.tags[COLORMAP], np.uint16).reshape(3, -1) >> 8
        out[..., :3] = table[:, a[..., 0]].transpose(1, 2, 0)
    elif photometric == 5 and n >= 4:
        ink = 255 - eight(a[..., :4]).astype(np.uint16)
        out[..., :3] = ink[..., :3] * ink[..., 3:] // 255
    elif photometric == 6 and n == 3 and tuple(d.tags.get(SUBSAMPLING, (2, 2))) == (1, 1):
        y, blue, red = (eight(a[..., k]).astype(np.float64) for k in range(3))
        blue, red = blue - 128, red - 128
        for k, v in enumerate((y + 1.402 * red, y - 0.344136 * blue - 0.714136 * red, y + 1.772 * blue)):
            out[..., k] = np.clip(np.rint(v), 0, 255)
    else:
        raise Unsupported(f"TIFF photometric {photometric} of {n} samples of {bits} bits")
    return out


def blocks(d: Directory, window: tuple[int, int, int, int] | None = None) -> list[tuple[int, int, int, int, int]]:
    """(block number, x, y, rows and columns inside the image) of the blocks that touch the window."""
    (w, h), (bw, bh) = d.size, d.block
    x0, y0, ww, wh = window or (0, 0, w, h)
    across = math.ceil(w / bw)
    return [(j * across + i, i * bw, j * bh, min(bw, w - i * bw), min(bh, h - j * bh)) for j in range(y0 // bh, (y0 + wh - 1) // bh + 1) for i in range(x0 // bw, (x0 + ww - 1) // bw + 1)]


def block(d: Directory, raw: list[bytes], w: int, h: int):
    """Pixels (h, w, 4) of a block from its bytes in the file, one for each plane."""
    planes = [unpacked(x, d.one(COMPRESSION, 1)) for x in raw]
    bw, bh = d.block
    return rgba(d, planes, bw, bh if d.tiled else h)[:h, :w]


def read_window(fetch, all_: list[Directory], window: tuple[int, int, int, int], out_w: int, out_h: int, wanted=lambda: True):
    """(level, clipped window, pixels (out_h, out_w, 4)): only blocks of the chosen directory that the window touches are read.

    ``wanted`` is asked before each block; the read ends with Cancelled when it says no.
    """
    import numpy as np

    x, y, w, h = window
    if x < 0 or y < 0 or w <= 0 or h <= 0 or out_w <= 0 or out_h <= 0:
        raise ValueError("the window is invalid")
    base_w, base_h = all_[0].size
    w, h = min(x + w, base_w) - x, min(y + h, base_h) - y
    if w <= 0 or h <= 0:
        raise ValueError("the window is outside the raster")
    need, level, best = max(w / out_w, h / out_h), 0, 0.0
    for i, _, _, dx, dy in overviews(all_):
        if 1 <= max(dx, dy) <= need and max(dx, dy) >= best:
            level, best = i, max(dx, dy)
    d = all_[level]
    lw, lh = d.size
    sx, sy = base_w / lw, base_h / lh
    left, top = min(max(math.floor(x / sx), 0), lw - 1), min(max(math.floor(y / sy), 0), lh - 1)
    right, bottom = min(max(math.ceil((x + w) / sx), left + 1), lw), min(max(math.ceil((y + h) / sy), top + 1), lh)
    cut = np.zeros((bottom - top, right - left, 4), np.uint8)
    for number, bx, by, bw, bh in blocks(d, (left, top, right - left, bottom - top)):
        if not wanted():
            raise Cancelled
        pixels = block(d, [fetch(*place) for place in d.places(number)], bw, bh)
        x0, x1, y0, y1 = max(left, bx), min(right, bx + bw), max(top, by), min(bottom, by + bh)
        cut[y0 - top : y1 - top, x0 - left : x1 - left] = pixels[y0 - by : y1 - by, x0 - bx : x1 - bx]
    return level, (x, y, w, h), nearest(cut, out_w, out_h)


def nearest(pixels, out_w: int, out_h: int):
    """Pixels in another size, each output pixel from the source pixel under its centre."""
    import numpy as np

    h, w = pixels.shape[:2]
    if (w, h) == (out_w, out_h):
        return pixels
    xs = np.minimum(w - 1, (2 * np.arange(out_w, dtype=np.int64) + 1) * w // (2 * out_w))
    ys = np.minimum(h - 1, (2 * np.arange(out_h, dtype=np.int64) + 1) * h // (2 * out_h))
    return pixels[ys][:, xs]


def encode(images: list[tuple], *, tile: int | None = None, strip_rows: int | None = None, compression: int = 8, tags: dict | None = None, planar: bool = False) -> bytes:
    """A little-endian TIFF of arrays (h, w, bands) of 8 or 16 bits, the first being the base; ``tags`` (tag -> (type, values)) go to the first.

    ``planar`` writes each band in a plane of its own.
    """
    import numpy as np

    out, directories_ = bytearray(b"II*\0\0\0\0\0"), []
    for number, (a, photometric) in enumerate(images):
        h, w, n = a.shape
        pieces = []
        for plane in [a[..., k : k + 1] for k in range(n)] if planar else [a]:
            if tile:
                for j in range(0, h, tile):
                    for i in range(0, w, tile):
                        t = np.zeros((tile, tile, plane.shape[2]), a.dtype)
                        cut = plane[j : j + tile, i : i + tile]
                        t[: cut.shape[0], : cut.shape[1]] = cut
                        pieces.append(t.tobytes())
            else:
                rows = strip_rows or h
                pieces += [plane[j : j + rows].tobytes() for j in range(0, h, rows)]
        packed = [zlib.compress(p) if compression == 8 else p for p in pieces]
        offsets = []
        for p in packed:
            offsets.append(len(out))
            out += p + b"\0" * (len(p) % 2)
        entries = {WIDTH: (4, [w]), HEIGHT: (4, [h]), BITS: (3, [8 * a.dtype.itemsize] * n), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [photometric]), SAMPLES: (3, [n]), PLANAR: (3, [2 if planar else 1])}
        if tile:
            entries |= {TILE_W: (3, [tile]), TILE_H: (3, [tile]), TILES: (4, offsets), TILE_BYTES: (4, [len(p) for p in packed])}
        else:
            entries |= {STRIPS: (4, offsets), STRIP_ROWS: (4, [strip_rows or h]), STRIP_BYTES: (4, [len(p) for p in packed])}
        if number == 0:
            entries |= tags or {}
        directories_.append(entries)
    link = 4
    for entries in directories_:
        table = []
        for tag, (kind, values) in sorted(entries.items()):
            data = values.encode("latin-1") + b"\0" if isinstance(values, str) else struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
            count = len(data) if isinstance(values, str) else len(values)
            if len(data) > 4:
                place = len(out)
                out += data + b"\0" * (len(data) % 2)
                data = struct.pack("<I", place)
            table.append(struct.pack("<HHI", tag, kind, count) + data.ljust(4, b"\0"))
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(table)) + b"".join(table)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)
