"""Feature sinks: every partition of a DataFrame becomes a file of its own in a folder, or several Shapefiles if it is large."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame

from . import files, geojson, geopackage, shapefile

#: A Shapefile is closed, and the next begun, when its SHP and DBF parts are longer than this together.
FILE_BYTES = 32 << 20


def _values(geometry: dict | None) -> dict | None:
    if geometry is None:
        return None
    return {"type": geometry["type"], "members": [m | {"parts": [[[(p["x"], p["y"], p["z"], p["m"]) for p in ring] for ring in part] for part in m["parts"]]} for m in geometry["members"]]}


def write_features(df: DataFrame, folder: str, format: str, *, columns: list[tuple[str, str]] | None = None, fields: list[tuple[str, str, int, int]] | None = None, codec: str = "utf-8", cpg: str = "UTF-8") -> list[str]:
    """Write (id, geometry, the other columns) and return the files. A partition's rows must fit in memory, but for Shapefiles, which are written batch by batch.

    ``columns``: (name, SQL type) of a GeoPackage; ``fields``: DBF fields of a Shapefile, ``codec`` and ``cpg`` its encoding and what its CPG file says.
    """

    def shapefiles(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from . import shapecolumns

        shapes, rows = shapefile.Shapes(), []

        def closed():
            name = f"part_{uuid.uuid4().hex}"
            shp, shx = shapes.files()
            dbf = b"".join([shapefile.encode_head(fields, shapes.n), *rows, b"\x1a"])
            for extension, data in (("shp", shp), ("shx", shx), ("dbf", dbf), ("cpg", cpg.encode())):
                files.write(f"{folder}/{name}.{extension}", data)
            return pa.record_batch([pa.array([name])], names=["file"])

        for b in batches:
            if b.num_rows:
                shapes.add(shapecolumns.encode(b.column("geometry")))
                rows.append(shapecolumns.encode_rows(fields, b, codec))
            if shapes.bytes + sum(map(len, rows)) > FILE_BYTES:
                yield closed()
                shapes, rows = shapefile.Shapes(), []
        if shapes.n:
            yield closed()

    def written(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rows = [r for b in batches for r in b.to_pylist()]
        name = f"part_{uuid.uuid4().hex}"
        if rows:
            shapes = [_values(r.pop("geometry")) for r in rows]
            if format == "geojson":
                features = [{"type": "Feature", "id": r["id"], "geometry": geojson.to_geometry(g), "properties": {k: v for k, v in r.items() if k != "id"}} for r, g in zip(rows, shapes)]
                files.write(f"{folder}/{name}.geojson", json.dumps({"type": "FeatureCollection", "features": features}, ensure_ascii=False).encode())
            elif format == "geopackage":
                values = [(r["id"], g, [r[c] for c, _ in columns]) for r, g in zip(rows, shapes)]
                files.write(f"{folder}/{name}.gpkg", geopackage.encode([{"name": name, "kind": shapes[0]["type"].upper(), "srs": 4326, "columns": columns, "rows": values, "index": True}]))
            else:
                raise ValueError(f"no writer for {format}")
            yield pa.record_batch([pa.array([name])], names=["file"])

    return [r["file"] for r in df.mapInArrow(shapefiles if format == "shapefile" else written, "file string").collect()]
