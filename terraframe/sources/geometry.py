"""Geometries as plain Python values, and their decoding from GeoJSON, Shapefile records and GeoPackage blobs.

A position is (x, y, z, m). A geometry is {"type", "members"}, a member {"path", "type", "declared", "parts"}.
"""

from __future__ import annotations

import math
import struct

Box = dict | None


class Malformed(ValueError):
    """The data breaks the rules of its format."""


class Unsupported(ValueError):
    """The data is of a kind that isn't read."""


def box(minx, miny, maxx, maxy, minz=None, maxz=None) -> dict:
    return {"minx": minx, "miny": miny, "maxx": maxx, "maxy": maxy, "minz": minz, "maxz": maxz}


def member(kind: str, parts: list, declared: Box = None, path: tuple[int, ...] = ()) -> dict:
    return {"path": list(path), "type": kind, "declared": declared, "parts": parts}


def single(kind: str, parts: list, declared: Box = None) -> dict:
    return {"type": kind, "members": [member(kind, parts, declared)]}


def positions(geometry: dict | None):
    for m in (geometry or {"members": []})["members"]:
        for part in m["parts"]:
            for ring in part:
                yield from ring


def bounds(geometry: dict | None) -> tuple[float, float, float, float] | None:
    """Bounds of all positions, None if there are none; NaN spoils its axis."""
    found = list(positions(geometry))
    if not found:
        return None
    sides = []
    for axis in (0, 1):
        values = [p[axis] for p in found]
        total = sum(values)  # NaN if one of them is, or if both infinities are there
        spoiled = total != total and any(map(math.isnan, values))
        sides.append((math.nan, math.nan) if spoiled else (min(values), max(values)))
    return sides[0][0], sides[1][0], sides[0][1], sides[1][1]


def intersects(a, b) -> bool:
    """Inclusive; false for None, NaN and inverted bounds."""
    if a is None or b is None:
        return False
    return a[0] <= a[2] and a[1] <= a[3] and b[0] <= b[2] and b[1] <= b[3] and a[0] <= b[2] and a[2] >= b[0] and a[1] <= b[3] and a[3] >= b[1]


def as_array(geometries: list[dict | None], kind):
    """The geometries as an Arrow array of type ``kind``, built column by column."""
    import numpy as np
    import pyarrow as pa

    member = kind.field("members").type.value_type
    coord = member.field("parts").type.value_type.value_type.value_type
    members = [m for g in geometries if g is not None for m in g["members"]]
    parts = [p for m in members for p in m["parts"]]
    rings = [r for p in parts for r in p]
    flat = [c for r in rings for c in r]

    def listed(holders: list, values):
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(h) for h in holders])]).astype(np.int32)), values)

    columns = list(zip(*flat)) if flat else [()] * 4
    coords = pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in columns], fields=list(coord))
    by_ring = listed(rings, coords)
    by_part = listed(parts, by_ring)
    by_member = listed([m["parts"] for m in members], by_part)
    whole = pa.StructArray.from_arrays([pa.array([m["path"] for m in members], member.field("path").type), pa.array([m["type"] for m in members], pa.string()), pa.array([m["declared"] for m in members], member.field("declared").type), by_member], fields=list(member))
    held = listed([g["members"] if g is not None else () for g in geometries], whole)
    types = pa.array([g and g["type"] for g in geometries], pa.string())
    return pa.StructArray.from_arrays([types, held], fields=list(kind), mask=pa.array([g is None for g in geometries], pa.bool_()))


class Cursor:
    """Reads numbers from bytes; reading past the end is an error."""

    def __init__(self, data: bytes, at: int = 0, what: str = "data") -> None:
        self.data, self.at, self.what = data, at, what

    def take(self, form: str) -> tuple:
        n = struct.calcsize(form)
        if self.at + n > len(self.data):
            raise Malformed(f"{self.what} is truncated")
        out = struct.unpack_from(form, self.data, self.at)
        self.at += n
        return out

    def one(self, form: str):
        return self.take(form)[0]

    def doubles(self, n: int, order: str = "<") -> list[float]:
        if n < 0 or self.at + 8 * n > len(self.data):
            raise Malformed(f"{self.what} is truncated")
        return list(self.take(f"{order}{n}d"))


# Shapefile records

#: Shape types by family, and those with z and with m.
_POINT, _LINE, _POLYGON, _MULTIPOINT = (1, 11, 21), (3, 13, 23), (5, 15, 25), (8, 18, 28)
_HAS_Z, _HAS_M = (11, 13, 15, 18), (11, 13, 15, 18, 21, 23, 25, 28)


def _measure(m: float) -> float | None:
    return None if m <= -1e38 or math.isnan(m) or math.isinf(m) else m


def shape(content: bytes) -> dict | None:
    """The geometry of a Shapefile record's content; a null shape is None. All rings of a polygon are one polygon."""
    c = Cursor(content, what="a shape record")
    kind = c.one("<i")
    if kind == 0:
        return None
    if kind in _POINT:
        x, y = c.take("<2d")
        z = c.one("<d") if kind in _HAS_Z else None
        m = _measure(c.one("<d")) if kind in _HAS_M and len(content) - c.at >= 8 else None
        return single("Point", [[[(x, y, z, m)]]])
    if kind not in (*_LINE, *_POLYGON, *_MULTIPOINT):
        raise Unsupported(f"shape type {kind}")
    declared = c.take("<4d")
    n_parts = 0 if kind in _MULTIPOINT else c.one("<i")
    n = c.one("<i")
    if n < 0 or n_parts < 0:
        raise Malformed("a shape record has a negative count")
    starts = list(c.take(f"<{n_parts}i")) if n_parts else []
    if starts and (starts[0] != 0 or any(a > b for a, b in zip(starts, [*starts[1:], n]))):
        raise Malformed("parts of a shape record don't follow one another")
    if n and not n_parts and kind not in _MULTIPOINT:
        raise Malformed("a shape record has points but no part")
    xy = c.doubles(2 * n)
    zs, ms, zrange = [None] * n, [None] * n, (None, None)
    if kind in _HAS_Z:
        zrange = c.take("<2d")
        zs = c.doubles(n)
    if kind in _HAS_M and len(content) - c.at >= 16 + 8 * n:
        c.take("<2d")
        ms = [_measure(m) for m in c.doubles(n)]
    points = list(zip(xy[::2], xy[1::2], zs, ms))
    known = box(*declared, *zrange)
    if kind in _MULTIPOINT:
        return single("MultiPoint", [[[p]] for p in points], known)
    rings = [points[a:b] for a, b in zip(starts, [*starts[1:], n])]
    if kind in _POLYGON:
        return single("Polygon", [rings], known)
    return single("LineString", [[rings[0]]], known) if len(rings) == 1 else single("MultiLineString", [[r] for r in rings], known)


def shape_bounds(prefix: bytes) -> tuple[float, float, float, float] | None:
    """Bounds from the first 36 bytes of a record's content, without decoding it; None for a null shape."""
    c = Cursor(prefix, what="a shape record")
    kind = c.one("<i")
    if kind == 0:
        return None
    if kind in _POINT:
        x, y = c.take("<2d")
        return x, y, x, y
    return c.take("<4d")


# WKB

_WKB = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}


def _wkb(c: Cursor, depth: int = 0) -> dict | None:
    if depth > 64:
        raise Malformed("WKB is nested too deeply")
    order = {0: ">", 1: "<"}.get(c.one("<B"))
    if order is None:
        raise Malformed("WKB byte order must be 0 or 1")
    raw = c.one(order + "I")
    has_z, has_m, base = bool(raw & 0x80000000), bool(raw & 0x40000000), raw & 0x1FFFFFFF
    if raw & 0x20000000:
        c.take("<4x")
    if 1000 <= base < 4000:
        has_z, has_m, base = has_z or base // 1000 in (1, 3), has_m or base // 1000 in (2, 3), base % 1000
    kind = _WKB.get(base)
    if kind is None:
        raise Unsupported(f"WKB geometry type {base}")

    def points(n: int) -> list[tuple]:
        width = 2 + has_z + has_m
        flat = c.doubles(n * width, order)
        out = []
        for i in range(0, len(flat), width):
            v = flat[i : i + width]
            out.append((v[0], v[1], v[2] if has_z else None, v[-1] if has_m else None))
        return out

    def count() -> int:
        n = c.one(order + "I")
        if n > len(c.data):
            raise Malformed("WKB is truncated")
        return n

    if kind == "Point":
        (p,) = points(1)
        return None if math.isnan(p[0]) and math.isnan(p[1]) else single("Point", [[[p]]])
    if kind == "LineString":
        line = points(count())
        return single("LineString", [[line]] if line else [])
    if kind == "Polygon":
        rings = [points(count()) for _ in range(count())]
        return single("Polygon", [rings] if rings else [])
    children = [_wkb(c, depth + 1) for _ in range(count())]
    if kind == "GeometryCollection":
        members = []
        for i, g in enumerate(x for x in children if x is not None):
            members += [m | {"path": [i, *m["path"]]} for m in g["members"]]
        return {"type": kind, "members": members}
    wanted = kind.removeprefix("Multi")
    if any(g is not None and g["type"] != wanted for g in children):
        raise Malformed(f"a {kind} holds another kind of geometry")
    return single(kind, [part for g in children if g is not None for part in (g["members"][0]["parts"] or ([[[]]] if wanted == "LineString" else [[]]))])


def wkb(data: bytes) -> dict | None:
    """The geometry of WKB or EWKB; a point of two NaN is None. Bytes after the geometry are accepted."""
    return _wkb(Cursor(data, what="WKB"))


def gpkg_blob(data: bytes) -> tuple[dict | None, int, Box, bool]:
    """(geometry, reference system id, declared box, empty) of a GeoPackage geometry blob."""
    c = Cursor(data, what="a GeoPackage geometry")
    magic, version, flags = c.take("<2sBB")
    if magic != b"GP":
        raise Malformed("a GeoPackage geometry must begin with GP")
    if version != 0:
        raise Unsupported(f"GeoPackage geometry version {version}")
    if flags & 0xC0:
        raise Malformed("a GeoPackage geometry uses reserved flags")
    if flags & 0x20:
        raise Unsupported("extended GeoPackage geometries")
    order = "<" if flags & 1 else ">"
    srs = c.one(order + "i")
    code = flags >> 1 & 7
    if code > 4:
        raise Malformed("a GeoPackage geometry has an unknown envelope")
    e = c.doubles((0, 4, 6, 6, 8)[code], order)
    declared = box(e[0], e[2], e[1], e[3], *(e[4:6] if code in (2, 4) else ())) if e else None
    geometry = _wkb(c)
    empty = bool(flags & 0x10)
    if empty and geometry is not None:
        geometry = None if geometry["type"] == "Point" else {"type": geometry["type"], "members": [] if geometry["type"] == "GeometryCollection" else [member(geometry["type"], [])]}
    if geometry is not None and declared is not None:
        geometry = {"type": geometry["type"], "members": [m | {"declared": m["declared"] or declared} for m in geometry["members"]]}
    return geometry, srs, declared, empty


def to_wkb(geometry: dict) -> bytes:
    """Little-endian ISO WKB of a geometry that isn't a collection; z and m follow its first position."""
    m = geometry["members"][0]
    first = next(positions(geometry), (0, 0, None, None))
    has_z, has_m = first[2] is not None, first[3] is not None
    shift = 1000 * has_z + 2000 * has_m
    code = next(k for k, v in _WKB.items() if v == geometry["type"])

    def head(k: int) -> bytes:
        return struct.pack("<BI", 1, k + shift)

    def point(p: tuple) -> bytes:
        return struct.pack(f"<{2 + has_z + has_m}d", *[v for v, has in zip(p, (True, True, has_z, has_m)) if has])

    def line(ring: list) -> bytes:
        return struct.pack("<I", len(ring)) + b"".join(map(point, ring))

    def rings(part: list) -> bytes:
        return struct.pack("<I", len(part)) + b"".join(map(line, part))

    parts = m["parts"]
    if code == 1:
        return head(1) + point(parts[0][0][0])
    if code == 2:
        return head(2) + line(parts[0][0] if parts else [])
    if code == 3:
        return head(3) + rings(parts[0] if parts else [])
    each = {4: lambda p: head(1) + point(p[0][0]), 5: lambda p: head(2) + line(p[0]), 6: lambda p: head(3) + rings(p)}[code]
    return head(code) + struct.pack("<I", len(parts)) + b"".join(map(each, parts))


def to_gpkg_blob(geometry: dict | None, srs: int) -> bytes | None:
    """A little-endian GeoPackage geometry with an XY envelope."""
    if geometry is None:
        return None
    b = bounds(geometry)
    head = struct.pack("<2sBBi", b"GP", 0, 1 | (2 if b else 16), srs)
    return head + (struct.pack("<4d", b[0], b[2], b[1], b[3]) if b else b"") + to_wkb(geometry)
