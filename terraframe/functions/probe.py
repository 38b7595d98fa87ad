"""Which reader a path is for, by its extension in any case; contents aren't looked at."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Format and confidence of each extension.
FORMATS = {
    ".geojson": ("geojson", 100), ".json": ("geojson", 50), ".shp": ("shapefile", 100), ".gpkg": ("geopackage", 100),
    ".tif": ("geotiff", 90), ".tiff": ("geotiff", 90), ".png": ("worldimage", 70), ".jpg": ("worldimage", 70), ".jpeg": ("worldimage", 70),
}


def probe(path: Column) -> Column:
    """Struct (is_match, format, confidence); a path that no reader takes has no format and confidence 0."""
    extension = F.lower(F.regexp_extract(path, r"\.[^./\\]+$", 0))
    name, trust = F.lit(None).cast("string"), F.lit(0)
    for e, (f, c) in FORMATS.items():
        name, trust = F.when(extension == e, f).otherwise(name), F.when(extension == e, c).otherwise(trust)
    return F.struct(name.isNotNull().alias("is_match"), name.alias("format"), trust.alias("confidence"))


def resolve(path: str) -> str:
    """The format of one path; raises if no reader takes it."""
    extension = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if extension not in FORMATS:
        raise ValueError(f"no reader for {path}")
    return FORMATS[extension][0]
