"""Raster reads on tables of blocks or pixels: prune blocks, cut a window, resample by nearest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import raster as R


def prune_tiles(blocks: DataFrame, window: tuple[int, int, int, int], tile_w: int, tile_h: int) -> DataFrame:
    """Tiles (tx, ty) that the window touches; plain comparisons, so partitions and row groups are pruned too."""
    x, y, w, h = window
    return blocks.filter(F.col("tx").between(x // tile_w, (x + w - 1) // tile_w) & F.col("ty").between(y // tile_h, (y + h - 1) // tile_h))


def prune_strips(blocks: DataFrame, window: tuple[int, int, int, int], rows_per_strip: int) -> DataFrame:
    _, y, _, h = window
    return blocks.filter(F.col("strip").between(y // rows_per_strip, (y + h - 1) // rows_per_strip))


def resample(pixels: DataFrame, window: tuple[int, int, int, int], out_w: int, out_h: int, values: list[str]) -> DataFrame:
    """(out_x, out_y, values): the window of a pixel table (px, py, values) in another size.

    Each pixel finds the output cells that take it, instead of each cell its pixel: no join is needed. Output index i takes
    source index s if s is its nearest, so the cells of s are an interval.
    """
    x, y, w, h = window
    inside = pixels.filter(F.col("px").between(x, x + w - 1) & F.col("py").between(y, y + h - 1))

    def cells(source, n: int, out: int):
        # (2i + 1) * n div (2 * out) = s   <=>   ceil((2 * out * s / n - 1) / 2) <= i < ceil((2 * out * (s + 1) / n - 1) / 2)
        edge = lambda s: F.ceil((F.lit(2 * out).cast("long") * s - n) / F.lit(2.0 * n))
        low, high = F.greatest(edge(source), F.lit(0).cast("long")), F.least(edge(source + 1), F.lit(out).cast("long")) - 1
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    sx, sy = F.col("px").cast("long") - x, F.col("py").cast("long") - y
    spread = inside.withColumn("out_x", F.explode(cells(sx, w, out_w))).withColumn("out_y", F.explode(cells(sy, h, out_h)))
    return spread.select("out_x", "out_y", *values)


def read_window(levels: dict[int, DataFrame], base: tuple[int, int], sizes: dict[int, tuple[int, int]], window: tuple[int, int, int, int], out_w: int, out_h: int, values: list[str]) -> tuple[int, DataFrame]:
    """(level, pixels): clip the window, choose the overview for the output size, map the window into it, resample.

    The clipped window fills the whole output. The choice is the planner's: only one level is read.
    """
    x, y, w, h = window
    if x < 0 or y < 0 or w <= 0 or h <= 0:
        raise ValueError("the window is invalid")
    w, h = min(x + w, base[0]) - x, min(y + h, base[1]) - y
    if w <= 0 or h <= 0:
        raise ValueError("the window is outside the raster")
    need = max(w / out_w, h / out_h)
    chosen, best = 0, 0.0
    for level, (lw, lh) in sizes.items():
        if level and lw < base[0] and lh < base[1]:
            d = max(base[0] / lw, base[1] / lh)
            if 1 <= d <= need and d >= best:
                chosen, best = level, d
    lw, lh = sizes.get(chosen, base)
    fx, fy = base[0] / lw, base[1] / lh
    left, top = min(max(int(x // fx), 0), lw - 1), min(max(int(y // fy), 0), lh - 1)
    right, bottom = min(max(int(-(-(x + w) // fx)), left + 1), lw), min(max(int(-(-(y + h) // fy)), top + 1), lh)
    return chosen, resample(levels[chosen], (left, top, right - left, bottom - top), out_w, out_h, values)


def band_table(df: DataFrame, photometric: str, samples: str) -> DataFrame:
    """One row per band with what it shows."""
    return df.withColumn("band", F.explode(F.sequence(F.lit(0), F.col(samples) - 1))).withColumn("color", R.band_color(F.col(photometric), F.col("band"), F.col(samples)))
