"""Types of the data model: coordinates, envelopes, geometries, features, reference systems, rasters.

A geometry is stored flat, since a Spark struct can't contain itself: ``members`` has one entry, or one per leaf of a
collection with the leaf's path; a member's coordinates are parts of rings of positions. Point: one part, one ring, one position;
MultiPoint: a part per point; LineString: one part, one ring; MultiLineString: a part per line; Polygon: one part, a ring per ring;
MultiPolygon: a part per polygon. A null geometry and an empty one stay distinct.
"""

from __future__ import annotations

COORD = "struct<x:double,y:double,z:double,m:double>"
ENVELOPE = "struct<minx:double,miny:double,maxx:double,maxy:double>"
BOX = "struct<minx:double,miny:double,maxx:double,maxy:double,minz:double,maxz:double>"
PARTS = f"array<array<array<{COORD}>>>"
MEMBER = f"struct<path:array<int>,type:string,declared:{BOX},parts:{PARTS}>"
GEOMETRY = f"struct<type:string,members:array<{MEMBER}>>"
CRS = "struct<authority:string,code:string,wkt:string,name:string>"
AFFINE = "struct<ox:double,a:double,b:double,oy:double,d:double,e:double>"
WINDOW = "struct<x:int,y:int,w:int,h:int>"
FEATURE = f"layer string, seq long, feature_id string, geometry {GEOMETRY}, declared_bounds {BOX}, minx double, miny double, maxx double, maxy double, attributes string"
VECTOR_LAYER = f"path string, source_kind string, layer string, crs {CRS}, bounds {ENVELOPE}, geometry_type string, feature_count long"
BAND = "struct<idx:int,sample_type:string,bits:int,color:string,nodata:double>"
OVERVIEW = "struct<level:int,w:int,h:int,decx:double,decy:double>"
RASTER_LAYER = f"path string, source_kind string, layer string, crs {CRS}, bounds {ENVELOPE}, width int, height int, band_count int, geotransform {AFFINE}, pixel_anchor string, bands array<{BAND}>, overviews array<{OVERVIEW}>, color_model string, is_tiled boolean"

KINDS = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection")


def arrow_schema(fields: str):
    """The pyarrow schema of a field list as above; tasks have no Spark session to parse it."""
    import pyarrow as pa

    plain = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}

    def split(text: str) -> list[str]:
        depth, start, out = 0, 0, []
        for i, c in enumerate(text):
            depth += (c == "<") - (c == ">")
            if c == "," and not depth:
                out.append(text[start:i])
                start = i + 1
        return [*out, text[start:]]

    def kind(text: str):
        text = text.strip()
        if text.startswith("array<"):
            return pa.list_(kind(text[6:-1]))
        if text.startswith("struct<"):
            return pa.struct([field(f, ":") for f in split(text[7:-1])])
        return plain[text]

    def field(text: str, mark: str):
        name, _, of = text.strip().partition(mark)
        return pa.field(name.strip(), kind(of))

    return pa.schema([field(f, " ") for f in split(fields)])
