"""Envelopes as Column expressions. Spark orders NaN above all numbers, so every test guards against it: bounds with NaN are invalid."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SIDES = ("minx", "miny", "maxx", "maxy")


def make(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return F.struct(minx.alias("minx"), miny.alias("miny"), maxx.alias("maxx"), maxy.alias("maxy"))


def flat(prefix: str = "") -> Column:
    return make(*[F.col(prefix + s) for s in SIDES])


def literal(box: tuple[float, float, float, float]) -> Column:
    return make(*[F.lit(float(v)) for v in box])


def _number(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def is_valid(e: Column) -> Column:
    """Least sides not above greatest ones, on both axes; false for nulls and NaN."""
    ok = _number(e["minx"]) & _number(e["miny"]) & _number(e["maxx"]) & _number(e["maxy"])
    return F.coalesce(ok & (e["minx"] <= e["maxx"]) & (e["miny"] <= e["maxy"]), F.lit(False))


def contains(e: Column, x: Column, y: Column) -> Column:
    """Whether a position is inside or on the edge of a valid envelope."""
    return F.coalesce(is_valid(e) & _number(x) & _number(y) & (x >= e["minx"]) & (x <= e["maxx"]) & (y >= e["miny"]) & (y <= e["maxy"]), F.lit(False))


def intersects(a: Column, b: Column) -> Column:
    """Whether two valid envelopes share a position; touching edges do."""
    meet = (a["minx"] <= b["maxx"]) & (a["maxx"] >= b["minx"]) & (a["miny"] <= b["maxy"]) & (a["maxy"] >= b["miny"])
    return F.coalesce(is_valid(a) & is_valid(b) & meet, F.lit(False))


def intersects_flat(box: tuple[float, float, float, float], prefix: str = "") -> Column:
    """``intersects`` of flat columns with a constant valid envelope, as conjuncts that reach a Parquet scan."""
    minx, miny, maxx, maxy = (F.col(prefix + s) for s in SIDES)
    x0, y0, x1, y1 = map(float, box)
    if not (x0 <= x1 and y0 <= y1):
        raise ValueError("the extent is invalid")
    pushed = (minx <= x1) & (maxx >= x0) & (miny <= y1) & (maxy >= y0)
    return pushed & ~F.isnan(minx) & ~F.isnan(miny) & ~F.isnan(maxx) & ~F.isnan(maxy) & (minx <= maxx) & (miny <= maxy)


def union(a: Column, b: Column) -> Column:
    """The envelope of both; an invalid one adds nothing."""
    both = make(F.least(a["minx"], b["minx"]), F.least(a["miny"], b["miny"]), F.greatest(a["maxx"], b["maxx"]), F.greatest(a["maxy"], b["maxy"]))
    return F.when(~is_valid(a), b).when(~is_valid(b), a).otherwise(both)


def of_coords(coords: Column) -> Column:
    """Bounds of an array of positions; null when it is empty; NaN on an axis spoils that axis."""
    xs, ys = F.transform(coords, lambda c: c["x"]), F.transform(coords, lambda c: c["y"])

    def side(values: Column, pick) -> Column:
        return F.when(F.exists(values, F.isnan), F.lit(float("nan"))).otherwise(pick(values))

    return F.when(F.size(coords) > 0, make(side(xs, F.array_min), side(ys, F.array_min), side(xs, F.array_max), side(ys, F.array_max)))


def of_parts(parts: Column) -> Column:
    """Bounds of parts of rings of positions."""
    return of_coords(F.flatten(F.flatten(parts)))


def of_geometry(geometry: Column) -> Column:
    """Bounds of all members of a geometry; null for a null or an empty one."""
    return of_parts(F.flatten(F.transform(geometry["members"], lambda m: m["parts"])))


def aggregate(prefix: str = "") -> Column:
    """The union over rows of flat columns, leaving out invalid ones."""
    ok = is_valid(flat(prefix))
    pick = lambda s, how: how(F.when(ok, F.col(prefix + s)))
    return make(pick("minx", F.min), pick("miny", F.min), pick("maxx", F.max), pick("maxy", F.max))


def feature_bounds(geometry_bounds: Column, declared: Column) -> Column:
    """A feature's bounds: those of its geometry, else the declared ones of the feature."""
    return F.coalesce(geometry_bounds, F.when(declared.isNotNull(), make(*[declared[s] for s in SIDES])))
