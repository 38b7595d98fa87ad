"""Layers as DataFrames: extent filters by format, layer selection, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import envelope as E, geometry as G

Box = tuple[float, float, float, float]


def extent_filter(df: DataFrame, box: Box) -> DataFrame:
    """Rows whose flat bounds intersect the extent; the comparisons reach the scan. An invalid extent raises."""
    return df.filter(E.intersects_flat(box))


def extent_filter_declared(df: DataFrame, box: Box, bounds: str = "bounds", declared: str = "declared_bounds") -> DataFrame:
    """Rows whose computed bounds, or else the declared ones of the feature, intersect the extent."""
    return df.filter(E.intersects(E.feature_bounds(F.col(bounds), F.col(declared)), E.literal(box)))


def point_in_extent(df: DataFrame, box: Box, x: str = "x", y: str = "y") -> DataFrame:
    return df.filter(E.contains(E.literal(box), F.col(x), F.col(y)))


def select_layer(df: DataFrame, name: str) -> DataFrame:
    """Rows of one layer, by its exact name."""
    return df.filter(F.col("layer") == name)


def live_rows(df: DataFrame, mark: str = "deleted") -> DataFrame:
    """Rows that aren't marked as deleted."""
    return df.filter(~F.coalesce(F.col(mark), F.lit(False)))


def metadata(df: DataFrame, keys: list[str], kind: str = "kind") -> DataFrame:
    """Per layer: number of features, single geometry kind (null if mixed), union of bounds."""
    box = E.aggregate()
    out = df.groupBy(*keys).agg(F.count("*").alias("feature_count"), G.uniform_kind(F.col(kind)).alias("geometry_type"), box.alias("b"))
    return out.select(*keys, "feature_count", "geometry_type", *[F.col(f"b.{s}").alias(s) for s in E.SIDES])


def extent(df: DataFrame, declared: Box | None = None) -> DataFrame:
    """One row: the declared box of the file if it has one, else the union of all bounds."""
    if declared is not None:
        return df.sparkSession.range(1).select(*[F.lit(float(v)).alias(s) for s, v in zip(E.SIDES, declared)])
    return df.agg(E.aggregate().alias("b")).select("b.*")
