"""Registered queries; importing this package fills the registry."""

from . import crs_queries, raster_queries, source_queries, vector_queries  # noqa: F401
