"""Features to drawable primitives.

A member is tested against the view before its parts are separated, so a MultiPoint that meets the view gives all its points. An
ancestor's bounds are the union of its leaves' bounds: if a leaf meets the view every ancestor does, and leaves are enough to test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import envelope as E

#: What is drawn for each kind of geometry.
PRIMITIVES = {"Point": "Point", "MultiPoint": "Point", "LineString": "Polyline", "MultiLineString": "Polyline", "Polygon": "Polygon", "MultiPolygon": "Polygon"}


def render_frame(features: DataFrame, view: tuple[float, float, float, float], geometry: str = "geometry") -> DataFrame:
    """(kind, minx, miny, maxx, maxy, rings, and the other columns of ``features``): one row per drawable part.

    Lines without positions are dropped; a polygon only if all its rings are empty, else all are kept.
    """
    x0, y0, x1, y1 = view
    if not (x0 <= x1 and y0 <= y1):
        raise ValueError("the view is invalid")
    others = [c for c in features.columns if c != geometry]
    members = features.filter(F.col(geometry).isNotNull()).select(*others, F.explode(F.col(geometry)["members"]).alias("_m"))
    seen = members.withColumn("_b", E.of_parts(F.col("_m.parts"))).filter(E.intersects(F.col("_b"), E.literal(view)))
    kind = F.lit(None).cast("string")
    for k, v in PRIMITIVES.items():
        kind = F.when(F.col("_m.type") == k, v).otherwise(kind)
    parts = seen.select(*others, kind.alias("_k"), F.explode("_m.parts").alias("_rings")).filter(F.exists("_rings", lambda r: F.size(r) > 0))
    out = parts.withColumn("_b", E.of_coords(F.flatten("_rings")))
    return out.select(F.col("_k").alias("kind"), *[F.col(f"_b.{s}").alias(s) for s in E.SIDES], F.col("_rings").alias("rings"), *[c for c in others if c not in ("kind", "rings", *E.SIDES)])
