"""Streams of viewport requests and of arriving feature files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema as S
from ..functions import envelope as E
from ..sources import geojson, geometry as G, readers


def latest_requests(requests: DataFrame, *, viewport: str = "viewport", at: str = "at", request: str = "request", delay: str = "10 seconds", every: str = "1 second") -> DataFrame:
    """(window, viewport, at, request): per span of time and viewport the request that no later one supersedes.

    ``at`` is the time of a request; state older than ``delay`` is dropped, and requests later than that are.
    """
    marked = requests.withWatermark(at, delay)
    newest = marked.groupBy(F.window(at, every), F.col(viewport)).agg(F.max(F.struct(at, request)).alias("newest"))
    return newest.select("window", viewport, F.col(f"newest.{at}").alias(at), F.col(f"newest.{request}").alias(request))


def arriving_features(spark: SparkSession, folder: str, *, extent: tuple[float, float, float, float] | None = None, files_per_trigger: int = 100) -> DataFrame:
    """Features (columns of ``schema.FEATURE``) of GeoJSON files as they arrive in a folder, one task for some files each.

    A file must appear whole, as by a rename. The extent filters as ``readers.read_features`` does.
    """
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.geojson").option("maxFilesPerTrigger", files_per_trigger)

    def decoded(batches):
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                layer = re.sub(r".*/|\.[^./]*$", "", path)
                found = geojson.features(geojson.parse(data.decode("utf-8-sig"), path))
                yield from readers.feature_batches((layer, seq, id, geometry, declared, G.bounds(geometry), attributes) for seq, (id, geometry, declared, attributes) in enumerate(found))

    out = source.load(folder).select("path", "content").mapInArrow(decoded, S.FEATURE)
    if extent is None:
        return out
    box = lambda s: F.coalesce(F.col(s), F.col("declared_bounds")[s])
    return out.filter(E.intersects(E.make(*[box(s) for s in E.SIDES]), E.make(*[F.lit(float(v)) for v in extent])))
