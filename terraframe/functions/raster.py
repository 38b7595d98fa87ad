"""Raster grids as Column expressions: windows, overviews, affine transforms, nearest neighbours. Index arithmetic is 64-bit."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def window(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), w.cast("int").alias("w"), h.cast("int").alias("h"))


def window_valid(v: Column) -> Column:
    return F.coalesce((v["x"] >= 0) & (v["y"] >= 0) & (v["w"] > 0) & (v["h"] > 0), F.lit(False))


def clip(v: Column, width: Column, height: Column) -> Column:
    """The part of a valid window inside the raster; null if there is none."""
    right, bottom = F.least(v["x"].cast("long") + v["w"], width.cast("long")), F.least(v["y"].cast("long") + v["h"], height.cast("long"))
    w, h = right - v["x"], bottom - v["y"]
    return F.when(window_valid(v) & (w > 0) & (h > 0), window(v["x"], v["y"], w, h))


def overviews(width: Column, height: Column, levels: Column) -> Column:
    """Of (level, w, h) those smaller than the base on both axes, with their decimation."""
    smaller = F.filter(levels, lambda o: (o["w"] < width) & (o["h"] < height))
    return F.transform(smaller, lambda o: F.struct(o["level"].alias("level"), o["w"].alias("w"), o["h"].alias("h"), (width / o["w"]).alias("decx"), (height / o["h"]).alias("decy")))


def select_overview(w: Column, h: Column, out_w: Column, out_h: Column, levels: Column) -> Column:
    """The level with the largest decimation from 1 up to what the output needs; of equal ones the later; 0 if none fits."""
    target = F.greatest(w / out_w, h / out_h)
    scored = F.transform(levels, lambda o, i: F.struct(F.greatest(o["decx"], o["decy"]).alias("d"), i.alias("i"), o["level"].alias("level")))
    best = F.array_max(F.filter(scored, lambda s: (s["d"] >= 1) & (s["d"] <= target)))
    return F.coalesce(best["level"], F.lit(0))


def map_window(v: Column, base_w: Column, base_h: Column, w: Column, h: Column) -> Column:
    """A window of the base in an overview of w x h: outward to whole pixels, inside it, at least one pixel."""
    sx, sy = base_w / w, base_h / h
    left = F.least(F.greatest(F.floor(v["x"] / sx), F.lit(0)), w - 1)
    top = F.least(F.greatest(F.floor(v["y"] / sy), F.lit(0)), h - 1)
    right = F.least(F.greatest(F.ceil((v["x"] + v["w"]) / sx), left + 1), w)
    bottom = F.least(F.greatest(F.ceil((v["y"] + v["h"]) / sy), top + 1), h)
    return window(left, top, right - left, bottom - top)


def nearest(i: Column, n: Column, out: Column) -> Column:
    """The source index of output index i when n pixels become ``out``."""
    i, n, out = i.cast("long"), n.cast("long"), out.cast("long")
    return F.least(n - 1, ((2 * i + 1) * n - F.pmod((2 * i + 1) * n, 2 * out)) / (2 * out)).cast("long")


def blocks(start: Column, size: Column, block: Column) -> Column:
    """Indices of the blocks that an interval of pixels touches."""
    first = F.floor(start / block).cast("long")
    return F.sequence(first, F.floor((start + size - 1) / block).cast("long"))


def affine(ox: Column, a: Column, b: Column, oy: Column, d: Column, e: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for n, c in zip(("ox", "a", "b", "oy", "d", "e"), (ox, a, b, oy, d, e))])


def pixel_to_world(t: Column, col: Column, row: Column) -> tuple[Column, Column]:
    return t["ox"] + col * t["a"] + row * t["b"], t["oy"] + col * t["d"] + row * t["e"]


def world_to_pixel(t: Column, x: Column, y: Column) -> Column:
    """Struct (col, row), null if the transform can't be inverted."""
    det = t["a"] * t["e"] - t["b"] * t["d"]
    fine = ~F.isnan(det) & (F.abs(det) < float("inf")) & (F.abs(det) > 5e-324)
    dx, dy = x - t["ox"], y - t["oy"]
    safe = F.when(fine, det)
    return F.when(fine, F.struct(((t["e"] * dx - t["b"] * dy) / safe).alias("col"), ((t["a"] * dy - t["d"] * dx) / safe).alias("row")))


def bounds(t: Column, width: Column, height: Column) -> Column:
    """The envelope of the four corners."""
    zero = F.lit(0.0)
    corners = [pixel_to_world(t, c, r) for c in (zero, width) for r in (zero, height)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return F.struct(F.least(*xs).alias("minx"), F.least(*ys).alias("miny"), F.greatest(*xs).alias("maxx"), F.greatest(*ys).alias("maxy"))


def from_tags(matrix: Column, scale: Column, tie: Column, anchor: Column) -> Column:
    """Affine of GeoTIFF tags: the matrix wins over scale and tie point; an anchor at pixel centres moves the origin by half a pixel."""
    m = lambda i: F.get(matrix, F.lit(i))
    s, t = (lambda i: F.get(scale, F.lit(i))), (lambda i: F.get(tie, F.lit(i)))
    full = affine(m(3), m(0), m(1), m(7), m(4), m(5))
    tied = affine(t(3) - t(0) * s(0), s(0), F.lit(0.0), t(4) + t(1) * s(1), F.lit(0.0), -s(1))
    raw = F.when(F.size(matrix) >= 16, full).when((F.size(scale) >= 2) & (F.size(tie) >= 6), tied)
    x, y = pixel_to_world(raw, F.lit(-0.5), F.lit(-0.5))
    return F.when((anchor == "Point") & raw.isNotNull(), affine(x, raw["a"], raw["b"], y, raw["d"], raw["e"])).otherwise(raw)


def from_world_file(text: Column) -> Column:
    """Affine of a world file: exactly six numbers a, d, b, e, x, y of which x and y are the centre of the first pixel; null if it isn't one."""
    parts = F.filter(F.split(text, r"\s+"), lambda p: p != "")
    v = F.transform(parts, lambda p: p.try_cast("double"))
    fine = (F.size(v) == 6) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    g = lambda i: F.get(v, F.lit(i))
    return F.when(fine, affine(g(4) - g(0) / 2 - g(2) / 2, g(0), g(2), g(5) - g(1) / 2 - g(3) / 2, g(1), g(3)))


def nodata(text: Column) -> Column:
    """The number in a nodata tag, without trailing NUL and blanks; null if it isn't one."""
    return F.trim(F.regexp_replace(text, "\\x00+$", "")).try_cast("double")


def band_color(photometric: Column, band: Column, samples: Column) -> Column:
    """What a band (from 0) shows, by the photometric tag."""
    gray = F.when(band == 0, "Gray").otherwise("Alpha")
    rgb = F.when(band == 0, "Red").when(band == 1, "Green").when(band == 2, "Blue").when(band == samples - 1, "Alpha").otherwise("Unknown")
    return F.when(photometric.isin(0, 1), gray).when(photometric.isin(2, 6), rgb).when((photometric == 3) & (band == 0), "Palette").otherwise("Unknown")


#: Names of the photometric tag.
COLOR_MODELS = {0: "WhiteIsZero", 1: "BlackIsZero", 2: "RGB", 3: "Palette", 5: "Separated", 6: "YCbCr"}


def color_model(photometric: Column) -> Column:
    out = F.concat(F.lit("TIFF Photometric "), photometric.cast("string"))
    for k, v in COLOR_MODELS.items():
        out = F.when(photometric == k, v).otherwise(out)
    return out


#: Bytes of a pixel by format.
PIXEL_BYTES = {"Gray8": 1, "GrayAlpha8": 2, "Rgb24": 3, "Rgba32": 4}


def buffer_valid(pixels: Column, w: Column, h: Column, pixel_format: Column) -> Column:
    size = F.lit(None).cast("int")
    for k, v in PIXEL_BYTES.items():
        size = F.when(pixel_format == k, v).otherwise(size)
    return F.coalesce(F.octet_length(pixels) == w.cast("long") * h * size, F.lit(False))


def geokey_crs(projected: Column, geographic: Column, projected_name: Column, geographic_name: Column) -> Column:
    """The system of GeoKeys: the projected code, then the geographic one, 0 and 32767 being none; else a citation as name."""
    usable = lambda c: F.when(~c.isin(0, 32767), c)
    code = F.coalesce(usable(projected), usable(geographic)).cast("string")
    null = F.lit(None).cast("string")
    cite = F.coalesce(*[F.when(F.trim(c) != "", c) for c in (projected_name, geographic_name)])
    name = F.when(code.isNotNull(), F.concat(F.lit("EPSG:"), code)).otherwise(cite)
    return F.struct(F.when(code.isNotNull(), "EPSG").alias("authority"), code.alias("code"), null.alias("wkt"), name.alias("name"))
