"""PNG and JPEG images with a world file: headers of both by ranges, pixels of PNG; those of JPEG come from Spark's image source (``readers``)."""

from __future__ import annotations

import struct
import zlib

from . import files
from .geometry import Malformed, Unsupported

#: World files looked for beside an image, in order.
WORLD_FILES = {".png": (".pgw", ".pngw", ".wld"), ".jpg": (".jgw", ".jpgw", ".wld"), ".jpeg": (".jgw", ".jpegw", ".wld")}
#: Bands by PNG colour type.
PNG_BANDS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def header(data) -> tuple[int, int, int]:
    """(width, height, bands) of a PNG or JPEG, from its bytes or from ``fetch(offset, length)``: only headers are read."""
    fetch = (lambda offset, length: data[offset : offset + length]) if isinstance(data, bytes) else data
    head = fetch(0, 33)
    if head[:8] == b"\x89PNG\r\n\x1a\n":
        w, h, _, kind = struct.unpack(">IIBB", head[16:26])
        return w, h, 3 if kind == 3 else PNG_BANDS[kind]
    if head[:2] == b"\xff\xd8":
        at = 2
        while len(mark := fetch(at, 10)) == 10:
            if mark[0] != 0xFF:
                raise Malformed("a JPEG marker is missing")
            if mark[1] == 0xFF:
                at += 1
                continue
            if 0xC0 <= mark[1] <= 0xCF and mark[1] not in (0xC4, 0xC8, 0xCC):
                h, w, n = struct.unpack(">HHB", mark[5:10])
                return w, h, n
            at += 2 + (0 if 0xD0 <= mark[1] <= 0xD9 else struct.unpack(">H", mark[2:4])[0])
    raise Malformed("neither a PNG nor a JPEG")


#: First column and row, and steps, of the seven passes of an interlaced PNG.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def png(data: bytes):
    """Pixels (h, w, 4) of a PNG; of 16-bit samples the upper half, fewer than 8 bits are stretched."""
    import numpy as np

    w, h, depth, kind, _, _, interlace = struct.unpack(">IIBBBBB", data[16:29])
    at, packed, palette, alpha = 8, [], None, b""
    while at < len(data):
        (n,), name = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if name == b"IDAT":
            packed.append(body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            alpha = body
        elif name == b"IEND":
            break
        at += 12 + n
    raw, bands = zlib.decompress(b"".join(packed)), PNG_BANDS[kind]
    a, place = np.zeros((h, w, bands), np.uint16), 0
    for x0, y0, dx, dy in PASSES if interlace else ((0, 0, 1, 1),):
        pw, ph = -(-(w - x0) // dx), -(-(h - y0) // dy)
        if pw <= 0 or ph <= 0:
            continue
        stride = -(-pw * bands * depth // 8)
        rows = _unfiltered(raw, place, stride, ph, max(1, bands * depth // 8))
        place += (stride + 1) * ph
        if depth == 16:
            part = rows.reshape(ph, pw, bands, 2).astype(np.uint16)
            part = part[..., 0] << 8 | part[..., 1]
        elif depth == 8:
            part = rows.reshape(ph, pw, bands)
        else:
            bits = np.unpackbits(rows, axis=1)[:, : pw * bands * depth].reshape(ph, pw, bands, depth)
            part = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=3, dtype=np.uint8)
        a[y0::dy, x0::dx] = part
    full = (1 << depth) - 1
    eight = (a >> 8 if depth == 16 else a if depth == 8 else a * 255 // full).astype(np.uint8)
    out = np.full((h, w, 4), 255, np.uint8)
    if kind == 3:
        out[..., :3] = palette[a[..., 0]]
        if alpha:
            table = np.full(256, 255, np.uint8)
            table[: len(alpha)] = np.frombuffer(alpha, np.uint8)
            out[..., 3] = table[a[..., 0]]
    elif bands < 3:
        out[..., :3] = eight[..., :1]
        if bands == 2:
            out[..., 3] = eight[..., 1]
    else:
        out[..., :bands] = eight
    if alpha and kind in (0, 2):  # one colour is transparent
        out[..., 3] = np.where((a == np.frombuffer(alpha, ">u2", bands)).all(axis=2), 0, 255)
    return out


def _unfiltered(raw: bytes, at: int, stride: int, h: int, step: int):
    """Rows (h, stride) of filtered PNG data; ``step`` is the distance of a byte from the one before it."""
    import numpy as np

    if len(raw) < at + h * (stride + 1):
        raise Malformed("PNG data is truncated")
    rows, last = np.zeros((h, stride), np.uint8), np.zeros(stride, np.uint8)
    for y in range(h):
        how, line = raw[at + y * (stride + 1)], np.frombuffer(raw, np.uint8, stride, at + y * (stride + 1) + 1)
        if how == 0:
            row = line
        elif how == 2:
            row = line + last
        elif how == 1:
            whole = -(-stride // step) * step
            row = np.cumsum(np.pad(line, (0, whole - stride)).reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[:stride]
        else:
            row = np.zeros(stride, np.uint8)
            for x in range(stride):
                a = int(row[x - step]) if x >= step else 0
                b = int(last[x])
                c = int(last[x - step]) if x >= step else 0
                guess = (a + b) // 2 if how == 3 else _paeth(a, b, c)
                row[x] = (int(line[x]) + guess) & 255
        rows[y] = last = row
    return rows


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
    return a if da <= db and da <= dc else b if db <= dc else c


def encode_png(pixels) -> bytes:
    """A PNG of an 8-bit array (h, w, 3 or 4)."""
    h, w, n = pixels.shape
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def affine(text: str) -> tuple[float, float, float, float, float, float]:
    """(ox, a, b, oy, d, e) of a world file of exactly six finite numbers; its origin is the centre of the first pixel."""
    import math

    try:
        v = [float(x) for x in text.split()]
    except ValueError as error:
        raise Malformed("a world file holds something that isn't a number") from error
    if len(v) != 6 or not all(map(math.isfinite, v)):
        raise Malformed("a world file needs exactly six finite numbers")
    a, d, b, e, x, y = v
    return x - (a + b) / 2, a, b, y - (d + e) / 2, d, e


def world_file(path: str) -> str | None:
    return files.sidecar(path, *WORLD_FILES.get(path[path.rfind(".") :].lower(), ()))
