"""Rules for positions, lines and rings, and names of geometry kinds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Shape type codes of the Shapefile format.
SHAPE_KINDS = {
    1: "Point", 3: "MultiLineString", 5: "Polygon", 8: "MultiPoint",
    11: "Point", 13: "MultiLineString", 15: "Polygon", 18: "MultiPoint",
    21: "Point", 23: "MultiLineString", 25: "Polygon", 28: "MultiPoint",
}
#: Geometry type names of the GeoPackage format.
NAMED_KINDS = {
    "POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString",
    "MULTIPOLYGON": "MultiPolygon", "GEOMETRYCOLLECTION": "GeometryCollection", "GEOMCOLLECTION": "GeometryCollection",
}


def _lookup(value: Column, table: dict) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def shape_kind(code: Column) -> Column:
    return _lookup(code, SHAPE_KINDS)


def named_kind(name: Column) -> Column:
    """Kind of a GeoPackage type name in any case; null for others (mixed or unknown)."""
    return _lookup(F.upper(F.trim(name)), NAMED_KINDS)


def position_valid(ordinates: Column) -> Column:
    """Two or three finite numbers; a fourth is never dropped."""
    finite = F.forall(ordinates, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(F.size(ordinates).isin(2, 3) & finite, F.lit(False))


def line_valid(coords: Column) -> Column:
    """No position or at least two."""
    return F.size(coords) != 1


def ring_valid(ring: Column) -> Column:
    """Empty, or at least four positions of which the last repeats the first in x, y and z."""
    first, last = F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)
    closed = (first["x"] == last["x"]) & (first["y"] == last["y"]) & first["z"].eqNullSafe(last["z"])
    return (F.size(ring) == 0) | ((F.size(ring) >= 4) & F.coalesce(closed, F.lit(False)))


def uniform_kind(kind: Column) -> Column:
    """Aggregate: the single kind of a layer, nulls left out; null when mixed or there is none."""
    return F.when(F.min(kind) == F.max(kind), F.min(kind))


def measure(m: Column) -> Column:
    """A Shapefile measure: null at or below -1e38 and for NaN or infinities."""
    return F.when(m.isNull() | F.isnan(m) | (m <= -1e38) | (F.abs(m) == float("inf")), None).otherwise(m)
