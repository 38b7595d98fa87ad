"""Shapefile records and DBF tables as Arrow columns: many records at once, without a Python object for each.

What isn't regular (faults among it) is left to ``geometry.shape`` and ``shapefile.row``, which say what is wrong.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .. import schema as S
from . import geometry as G, shapefile

GEOMETRY = S.arrow_schema(S.FEATURE).field("geometry").type
_MEMBER = GEOMETRY.field("members").type.value_type
_BOX = _MEMBER.field("declared").type
_COORD = _MEMBER.field("parts").type.value_type.value_type.value_type
_FAMILY = {"Point": 1, "MultiPoint": 8, "LineString": 3, "MultiLineString": 3, "Polygon": 5, "MultiPolygon": 5}
_SIDES = (np.minimum, np.minimum, np.maximum, np.maximum)


def _before(counts: np.ndarray) -> np.ndarray:
    """The sum of the counts before each."""
    return np.cumsum(counts) - counts


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each of the groups."""
    return np.arange(counts.sum()) - np.repeat(_before(counts), counts)


def _extremes(how, values: np.ndarray, counts: np.ndarray, blank: float) -> np.ndarray:
    """The least or greatest value of each group, NaN if one of its values is, ``blank`` for an empty group."""
    out = np.full(len(counts), blank)
    held = counts > 0
    if held.any():
        out[held] = how.reduceat(values, _before(counts)[held])
    return out


# Encoders


@dataclass(frozen=True)
class Records:
    """Records of a SHP file: the bytes without their numbers, where each begins, content lengths, shape types, and the bounds of all or None."""

    words: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    kinds: np.ndarray
    bounds: tuple[float, float, float, float] | None

    def numbered(self, first: int) -> bytes:
        """The records with numbers from ``first`` on."""
        self.words[self.starts] = np.arange(first, first + len(self.starts), dtype=">i4").view("<u4")
        return self.words.tobytes()


def encode(geometries) -> Records:
    """SHP records of an Arrow array of geometries (of their first members, as only collections have more); z is written if all positions have it, m if one has."""
    rows = len(geometries)
    there = geometries.is_valid().to_numpy(zero_copy_only=False)
    # a list's slots keep what a null geometry may hold below it; flattening leaves that out
    named = geometries.field("type").filter(pa.array(there))
    family = np.zeros(rows, np.int64)
    found = named.dictionary_encode()
    unknown = [k for k in found.dictionary.to_pylist() if k not in _FAMILY]
    if unknown or found.null_count:
        raise G.Unsupported(f"geometries of type {unknown[0] if unknown else None} in a Shapefile")
    if there.any():
        family[there] = np.array([_FAMILY[k] for k in found.dictionary.to_pylist()])[found.indices.to_numpy(zero_copy_only=False)]
    members = geometries.field("members").filter(pa.array(there))
    parts = pc.struct_field(pc.list_element(members, 0), "parts")
    if parts.null_count:
        raise G.Malformed("a geometry has no parts")
    n_of = lambda a: a.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    by_part = parts.flatten()
    by_ring = by_part.flatten()
    coords = by_ring.flatten()
    if by_part.null_count or by_ring.null_count or coords.null_count:
        raise G.Malformed("a geometry has a part, a ring or a position of null")

    def summed(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        ends = np.concatenate([[0], np.cumsum(values)])
        return ends[np.cumsum(counts)] - ends[_before(counts)]

    ring_n = n_of(by_ring)
    part_rings, parts_n = n_of(by_part), n_of(parts)
    rings, points = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    rings[there] = summed(part_rings, parts_n)
    points[there] = summed(summed(ring_n, part_rings), parts_n)
    x, y, z, m = coords.flatten()
    if x.null_count or y.null_count:
        raise G.Malformed("a position has no x or no y")
    x, y = (a.to_numpy(zero_copy_only=False) for a in (x, y))
    with_z = summed(z.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), points)
    with_m = summed(m.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), points)
    has_z, any_m = (points > 0) & (with_z == points), with_m > 0
    has_m = has_z | any_m
    point, multi, rest = family == 1, family == 8, (family == 3) | (family == 5)
    if (points[point] != 1).any():
        raise G.Malformed("a point needs one position")
    kinds = family + np.where(has_z, 10, np.where(any_m, 20, 0))
    # lengths and places in words of four bytes; a record's header has two
    shared = ~point & there
    xy_at = 2 + np.where(point, 1, np.where(multi, 10, 11 + rings))
    z_at = xy_at + 4 * points
    range_words = np.where(shared, 4, 0)
    m_at = z_at + np.where(has_z, range_words + 2 * points, 0)
    total = np.where(there, m_at + np.where(has_m, range_words + 2 * points, 0), 3)
    starts = _before(total)
    out = np.zeros(total.sum(), "<u4")

    def doubles(at: np.ndarray, values: np.ndarray) -> None:
        halves = np.ascontiguousarray(values, "<f8").view("<u4").reshape(-1, 2)
        out[at], out[at + 1] = halves[:, 0], halves[:, 1]

    lengths = 4 * (total - 2)
    out[starts + 1] = (lengths // 2).astype(">i4").view("<u4")
    out[starts + 2] = kinds
    sides = [_extremes(how, v, points, 0.0) for how, v in zip(_SIDES, (x, y, x, y))]
    for k, side in enumerate(sides):
        doubles((starts + 3 + 2 * k)[shared], side[shared])
    out[(starts + 11)[multi]] = points[multi]
    out[(starts + 11)[rest]] = rings[rest]
    out[(starts + 12)[rest]] = points[rest]
    ring_from = _before(ring_n) - np.repeat(_before(points), rings)
    ring_place, of_rest = np.repeat(starts + 13, rings) + _within(rings), np.repeat(rest, rings)
    out[ring_place[of_rest]] = ring_from[of_rest]
    step = _within(points)
    at = np.repeat(starts + xy_at, points) + 4 * step
    doubles(at, x)
    doubles(at + 2, y)
    for has, first, values, absent in ((has_z, z_at, z, np.nan), (has_m, m_at, m, -1e39)):
        if has.any():
            v = pc.fill_null(values, absent).to_numpy(zero_copy_only=False)
            mine, ranged = np.repeat(has, points), has & shared
            place = np.repeat(starts + first + range_words, points) + 2 * step
            doubles(place[mine], v[mine])
            for k, how in enumerate((np.minimum, np.maximum)):
                doubles((starts + first + 2 * k)[ranged], _extremes(how, v, points, 0.0)[ranged])
    held = points > 0
    whole = tuple(float(f.reduce(s[held])) for f, s in zip((np.fmin, np.fmin, np.fmax, np.fmax), sides)) if held.any() else None
    return Records(out, starts, lengths, kinds, whole)


def _fixed(values: pa.Array, width: int, what: str) -> np.ndarray:
    """Texts or bytes that all have ``width`` bytes, as an array (rows, width)."""
    if not len(values):
        return np.zeros((0, width), np.uint8)
    values = values.cast(pa.binary())
    if values.null_count or pc.min_max(pc.binary_length(values)).as_py() != {"min": width, "max": width}:
        raise G.Malformed(f"a value of DBF field {what} doesn't fit its {width} bytes")
    _, offsets, held = values.buffers()
    start = np.frombuffer(offsets, np.int32)[values.offset]
    return np.frombuffer(held, np.uint8)[start : start + len(values) * width].reshape(len(values), width)


def _cells(values: pa.Array, field: tuple[str, str, int, int], codec: str) -> np.ndarray:
    """The bytes (rows, width) of a DBF column."""
    name, kind, length, d = field
    if kind == "I" and pa.types.is_integer(values.type):
        return np.frombuffer(pc.fill_null(values.cast(pa.int32()), 0).to_numpy(zero_copy_only=False).astype("<i4").tobytes(), np.uint8).reshape(-1, 4)
    text = None
    if kind in "NF" and not d and pa.types.is_integer(values.type):
        text = pc.utf8_lpad(values.cast(pa.string()), length, " ")
    elif kind == "L" and pa.types.is_boolean(values.type):
        text = pc.if_else(values, "T", "F")
    if text is not None:
        return _fixed(pc.fill_null(text, " " * length), length, name)
    if kind in "NF" and pa.types.is_floating(values.type):
        if d:
            text = pa.array(["%*.*f" % (length, d, v) for v in values.to_numpy(zero_copy_only=False).tolist()])
            return _fixed(pc.if_else(values.is_valid(), text, " " * length), length, name)
        return _fixed(pa.array([shapefile.cell(v, kind, length, d, codec) for v in values.to_pylist()], pa.binary()), length, name)
    found = values.dictionary_encode()
    # one more for null
    cells = pa.array([*(shapefile.cell(v, kind, length, d, codec) for v in found.dictionary.to_pylist()), shapefile.cell(None, kind, length, d, codec)], pa.binary())
    return _fixed(cells.take(pc.fill_null(found.indices, len(cells) - 1)), length, name)


def encode_rows(fields: list[tuple[str, str, int, int]], rows: pa.RecordBatch, codec: str) -> bytes:
    """The records of a DBF file; a field that the rows don't have is blank."""
    n = rows.num_rows
    held = set(rows.schema.names)
    columns = [_cells(rows.column(f[0]) if f[0] in held else pa.nulls(n, pa.string()), f, codec) for f in fields]
    return np.concatenate([np.full((n, 1), 0x20, np.uint8), *columns], axis=1).tobytes()


# Decoders


def entries(data: bytes) -> np.ndarray:
    """``shapefile.entries`` of a piece of an SHX file without its header, as an array (records, 2)."""
    if len(data) % 8:
        raise G.Malformed("an SHX index ends inside an entry")
    a = np.frombuffer(data, ">i4").reshape(-1, 2).astype(np.int64)
    if (a < (50, 2)).any():
        raise G.Malformed("an SHX index has an entry out of range")
    return a * 2


def _list(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def _meets(sides, extent) -> np.ndarray:
    """``geometry.intersects`` of many; NaN compares false."""
    a, b, c, d = sides
    return (a <= c) & (b <= d) & (a <= extent[2]) & (c >= extent[0]) & (b <= extent[3]) & (d >= extent[1])


_KNOWN = np.zeros(32, bool)
_KNOWN[[0, *G._POINT, *G._LINE, *G._POLYGON, *G._MULTIPOINT]] = True
_NAMES = pa.array(["Point", "MultiPoint", "LineString", "MultiLineString", "Polygon"])


def decode(data: bytes, at: np.ndarray, lengths: np.ndarray, first: int, extent) -> tuple[np.ndarray, pa.Array, pa.Array, list] | None:
    """(places of the records in the extent, geometry, declared box, four sides) of records ``first``, .. that begin at bytes ``at`` of ``data``.

    None if a record isn't regular. Only records whose declared box meets the extent are decoded.
    """
    if (at < 0).any() or (at + 8 + lengths > len(data)).any() or (lengths < 4).any():
        return None
    words = np.frombuffer(data, "<u2", len(data) // 2)

    def ints(place: np.ndarray, order: str = "<") -> np.ndarray:
        return words[place[:, None] + np.arange(2)].view(f"{order}i4")[:, 0].astype(np.int64)

    def doubles(place: np.ndarray, n: int = 1) -> np.ndarray:
        return words[place[:, None] + np.arange(4 * n)].view("<f8")

    c = at // 2
    if (ints(c, ">") != np.arange(first, first + len(at))).any() or (ints(c + 2, ">") * 2 != lengths).any():
        return None
    c = c + 4
    kind = ints(c)
    if ((kind < 0) | (kind > 31)).any() or not _KNOWN[kind].all():
        return None
    point, null = np.isin(kind, G._POINT), kind == 0
    if (lengths < np.where(null, 4, np.where(point, 20, 36))).any():
        return None
    boxes = np.full((len(at), 4), np.nan)
    boxes[point] = doubles(c[point] + 2, 2)[:, [0, 1, 0, 1]]
    shared = ~point & ~null
    boxes[shared] = doubles(c[shared] + 2, 4)
    kept = np.arange(len(at))
    if extent is not None:
        kept = np.flatnonzero(_meets(boxes.T, extent))
        c, kind, point, null, shared, boxes, lengths = (a[kept] for a in (c, kind, point, null, shared, boxes, lengths))
    multi, polygon = np.isin(kind, G._MULTIPOINT), np.isin(kind, G._POLYGON)
    drawn = shared & ~multi
    has_z, has_m = np.isin(kind, G._HAS_Z), np.isin(kind, G._HAS_M)
    if (lengths[multi] < 40).any() or (lengths[drawn] < 44).any():
        return None
    n_rings, n = np.zeros(len(c), np.int64), point.astype(np.int64)
    n_rings[drawn] = ints(c[drawn] + 18)
    n[drawn], n[multi] = ints(c[drawn] + 20), ints(c[multi] + 18)
    if (n < 0).any() or (n_rings < 0).any() or (n[drawn & (n_rings == 0)] > 0).any():
        return None
    need = np.where(null, 4, np.where(point, 20, np.where(multi, 40, 44 + 4 * n_rings) + 16 * n)) + np.where(has_z, np.where(point, 8, 16 + 8 * n), 0)
    if (lengths < need).any():
        return None
    has_m &= lengths - need >= np.where(point, 8, 16 + 8 * n)
    ring_from = ints(np.repeat(c + 22, n_rings) + 2 * _within(n_rings))
    opens = _before(n_rings)[n_rings > 0]
    ring_to = np.append(ring_from[1:], 0)
    ring_to[(_before(n_rings) + n_rings - 1)[n_rings > 0]] = n[n_rings > 0]
    if (ring_from[opens] != 0).any() or (ring_to < ring_from).any():
        return None

    ranged = np.where(point, 0, 8)
    xy_at = c + np.where(point, 2, np.where(multi, 20, 22 + 2 * n_rings))
    z_at = xy_at + 8 * n
    m_at = z_at + np.where(has_z, ranged + 4 * n, 0)
    step = _within(n)
    xy = doubles(np.repeat(xy_at, n) + 8 * step, 2)

    def optional(has: np.ndarray, first_at: np.ndarray, measured: bool) -> pa.Array:
        if not has.any():
            return pa.nulls(len(step), pa.float64())
        mine = np.repeat(has, n)
        v = np.zeros(len(step))
        v[mine] = doubles((np.repeat(first_at + ranged, n) + 4 * step)[mine])[:, 0]
        absent = ~mine
        if measured:
            absent |= ~(v > -1e38) | np.isinf(v)
        return pa.array(v, mask=absent)

    x, y = np.ascontiguousarray(xy[:, 0]), np.ascontiguousarray(xy[:, 1])
    coords = pa.StructArray.from_arrays([pa.array(x), pa.array(y), optional(has_z, z_at, False), optional(has_m, m_at, True)], fields=list(_COORD))
    rings = np.where(point, 1, np.where(multi, n, n_rings))
    ring_n = np.ones(rings.sum(), np.int64)
    ring_n[np.repeat(drawn, rings)] = ring_to - ring_from
    parts = np.where(polygon, 1, rings)
    part_n = np.ones(parts.sum(), np.int64)
    part_n[np.repeat(polygon, parts)] = n_rings[polygon]
    zrange = np.zeros((len(c), 2))
    deep = has_z & shared
    zrange[deep] = doubles(z_at[deep], 2)
    sides = [pa.array(np.ascontiguousarray(boxes[:, k])) for k in range(4)] + [pa.array(np.ascontiguousarray(zrange[:, k]), mask=~deep) for k in range(2)]
    declared = pa.StructArray.from_arrays(sides, fields=list(_BOX), mask=pa.array(~shared))
    there = pa.array(~null)
    names = _NAMES.take(pa.array(np.where(point, 0, np.where(multi, 1, np.where(polygon, 4, np.where(n_rings == 1, 2, 3))))))
    n_there = int((~null).sum())
    members = pa.StructArray.from_arrays([_list(np.zeros(n_there, np.int64), pa.array([], pa.int32())), names.filter(there), declared.filter(there), _list(parts[~null], _list(part_n, _list(ring_n, coords)))], fields=list(_MEMBER))
    geometry = pa.StructArray.from_arrays([names, _list((~null).astype(np.int64), members)], fields=list(GEOMETRY), mask=pa.array(null))
    own = [_extremes(how, v, n, np.nan) for how, v in zip(_SIDES, (x, y, x, y))]
    bounds = [pa.array(s, mask=n == 0) for s in own]
    if extent is not None:
        hit = _meets(own, extent)  # no positions, no bounds: NaN
        if not hit.all():
            mask = pa.array(hit)
            kept, geometry, declared, bounds = kept[hit], geometry.filter(mask), declared.filter(mask), [b.filter(mask) for b in bounds]
    return kept, geometry, declared, bounds


def _text(a: np.ndarray) -> pa.Array | None:
    """ASCII texts without the blanks and zeros around them; None if a byte is none of ASCII."""
    if (a > 0x7F).any():
        return None
    n, width = a.shape
    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(np.ascontiguousarray(a))])
    return pc.utf8_trim(raw.cast(pa.binary()).cast(pa.string()), "\0 ")


def _numbers(a: np.ndarray, field: shapefile.Field) -> pa.Array | None:
    """Texts of numbers (blank: null) that are written as Python would write them again; None if one isn't."""
    if field.kind not in "NF" or field.decimals > 6:
        return None
    text = _text(a)
    if text is None:
        return None
    text = pc.if_else(pc.equal(text, ""), None, text)
    plain = "^(0|-?[1-9][0-9]*)$" if not field.decimals else r"^-?(0|[1-9][0-9]*)\.[0-9]{1,6}$"
    return text if pc.all(pc.match_substring_regex(text, plain)).as_py() is not False else None


def _distinct(a: np.ndarray, field: shapefile.Field, codec: str) -> tuple[list, pa.Array]:
    """The different values of a field, and which of them each row has."""
    n, width = a.shape
    found = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(np.ascontiguousarray(a))]).dictionary_encode()
    return [shapefile.value(b, field, codec) for b in found.dictionary.to_pylist()], found.indices


def _dumped(v) -> str:
    if type(v).__name__ == "Decimal":
        return str(v)
    return json.dumps(v if v is None or isinstance(v, (int, float, bool)) else str(v), ensure_ascii=False)


def records(data: bytes, t: shapefile.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes (rows, width), whether a row is there) of the records of a DBF file."""
    if len(data) < n * t.width:
        raise G.Malformed("a DBF record is truncated")
    a = np.frombuffer(data, np.uint8, n * t.width).reshape(n, t.width)
    return a, a[:, 0] != 0x2A


def _checked(a: np.ndarray) -> None:
    if (a[:, 0] != 0x20).any():
        raise G.Malformed("a DBF record has an unknown mark")


def as_json(a: np.ndarray, t: shapefile.Table, codec: str) -> pa.Array:
    """The rows (none of them deleted) as JSON objects."""
    _checked(a)
    pieces, before = [], "{"
    for f in t.fields:
        cells = a[:, f.offset : f.offset + f.length]
        text = _numbers(cells, f)
        if text is not None:
            text = pc.fill_null(text, "null")
        elif f.kind == "I" and f.length == 4:
            text = pa.array(np.ascontiguousarray(cells).view("<i4")[:, 0]).cast(pa.string())
        else:
            values, which = _distinct(cells, f, codec)
            text = pa.array([_dumped(v) for v in values], pa.string()).take(which)
        pieces += [before + json.dumps(f.name, ensure_ascii=False) + ":", text]
        before = ","
    if not pieces:
        return pa.array(["{}"] * len(a), pa.string())
    return pc.binary_join_element_wise(*pieces, "}", "")


def as_columns(a: np.ndarray, t: shapefile.Table, codec: str, kinds: list[pa.DataType]) -> list[pa.Array]:
    """The rows (none of them deleted) as typed columns."""
    _checked(a)
    out = []
    for f, kind in zip(t.fields, kinds):
        cells = a[:, f.offset : f.offset + f.length]
        text = _numbers(cells, f)
        if text is not None:
            out.append(text.cast(kind))
        else:
            values, which = _distinct(cells, f, codec)
            out.append(pa.array(values, kind).take(which))
    return out
