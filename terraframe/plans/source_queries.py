"""Queries on files: a table is written in a format, read back by its reader, and must equal the table.

Files go to the shared folder named by ``spark.checkpoint.dir``; where that is unset, one is made if driver and tasks are on one machine, as in tests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schema as S
from ..sources import files, geometry as G, geotiff, readers, worldimage, writers
from .registry import query
from .views import PARCELS, PIXELS, PLACES, VERTICES, parcels, pixels, places, routes, table

BOX = (0.0, -10.0, 40.0, 30.0)


def scratch(spark: SparkSession) -> str:
    return f"{files.shared(spark)}/files-{uuid.uuid4().hex}"


def _geometry(kind: str, parts: Column) -> Column:
    member = F.struct(F.array().cast("array<int>").alias("path"), F.lit(kind).alias("type"), F.lit(None).cast(S.BOX).alias("declared"), parts.cast(S.PARTS).alias("parts"))
    return F.struct(F.lit(kind).alias("type"), F.array(member).alias("members")).alias("geometry")


def _coord(x: Column, y: Column, z: Column | None = None) -> Column:
    none = F.lit(None).cast("double")
    return F.struct(x.alias("x"), y.alias("y"), (none if z is None else z).alias("z"), none.alias("m"))


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows dealt out by id, before they get geometries: a table of few row groups is read by few tasks, however many rows it has."""
    return rows.repartition("id")


def _points(spark, sf_dir, z: bool = False, deal=lambda rows: rows) -> DataFrame:
    p = deal(places(spark, sf_dir))
    point = _geometry("Point", F.array(F.array(F.array(_coord(F.col("x"), F.col("y"), F.col("value") if z else None)))))
    return p.select("id", point, "event_type", "value")


def _boxes(spark, sf_dir, deal=lambda rows: rows) -> DataFrame:
    p = deal(parcels(spark, sf_dir))
    c = lambda x, y: _coord(F.col(x), F.col(y))
    ring = F.array(c("minx", "miny"), c("maxx", "miny"), c("maxx", "maxy"), c("minx", "maxy"), c("minx", "miny"))
    return p.select("id", _geometry("Polygon", F.array(F.array(ring))), "p_name", "p_size")


def _lines(spark, sf_dir) -> DataFrame:
    r = routes(spark, sf_dir).filter(F.size("coords") > 1)
    return r.select("id", _geometry("LineString", F.array(F.array("coords"))), F.size("coords").alias("n"))


def _attribute(name: str, kind: str) -> Column:
    return F.get_json_object("attributes", f"$.{name}").cast(kind)


@query(f"WITH {PLACES} SELECT id::VARCHAR AS feature_id, x, y, event_type, value FROM places")
def geojson_scan(spark, sf_dir):
    folder = scratch(spark)
    writers.write_features(_points(spark, sf_dir), folder, "geojson")
    f = readers.read_features(spark, folder, format="geojson")
    return f.select("feature_id", F.col("minx").alias("x"), F.col("miny").alias("y"), _attribute("event_type", "string").alias("event_type"), _attribute("value", "double").alias("value"))


@query(f"WITH {PARCELS} SELECT id::VARCHAR AS feature_id, p_name, 5::INT AS positions FROM parcels WHERE minx <= 40 AND maxx >= 0 AND miny <= 30 AND maxy >= -10")
def geojson_extent(spark, sf_dir):
    folder = scratch(spark)
    writers.write_features(_boxes(spark, sf_dir), folder, "geojson")
    f = readers.read_features(spark, folder, format="geojson", extent=BOX)
    return f.select("feature_id", _attribute("p_name", "string").alias("p_name"), F.size(F.flatten(F.flatten(F.col("geometry.members")[0]["parts"]))).alias("positions"))


@query(f"WITH {PARCELS} SELECT id::VARCHAR AS feature_id, p_size::BIGINT AS size, id % 2 = 0 AS even, p_name || '!' AS tag FROM parcels")
def attributes_json(spark, sf_dir):
    """Attributes as a variant: numbers, booleans and nested lists keep their types."""
    folder = scratch(spark)
    b = _boxes(spark, sf_dir).select("id", "geometry", "p_size", (F.col("id") % 2 == 0).alias("even"), F.array(F.concat("p_name", F.lit("!"))).alias("tags"))
    writers.write_features(b, folder, "geojson")
    f = readers.with_variant(readers.read_features(spark, folder, format="geojson"))
    get = lambda path, kind: F.variant_get("attributes", path, kind)
    return f.select("feature_id", get("$.p_size", "bigint").alias("size"), get("$.even", "boolean").alias("even"), get("$.tags[0]", "string").alias("tag"))


def _collections(texts: DataFrame) -> str:
    """A folder with a feature collection for each partition of ``texts`` (f: a feature), written by its task."""
    folder = scratch(texts.sparkSession)

    def written(batches):
        import pyarrow as pa

        lines = [f for b in batches for f in b.column("f").to_pylist()]
        if lines:
            name = f"part_{uuid.uuid4().hex}"
            files.write(f"{folder}/{name}.geojson", f'{{"type":"FeatureCollection","features":[{",".join(lines)}]}}'.encode())
            yield pa.record_batch([pa.array([name])], names=["file"])

    texts.select("f").mapInArrow(written, "file string").count()
    return folder


@query(f"WITH {PARCELS} SELECT id::VARCHAR AS feature_id, minx AS d_minx, maxy + 1 AS d_maxy FROM parcels")
def geojson_bbox(spark, sf_dir):
    """Declared boxes of all features, which have no geometry here."""
    text = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("id"), F.array("minx", "miny", "maxx", F.col("maxy") + 1).alias("bbox"), F.struct("p_size").alias("properties")))
    folder = _collections(parcels(spark, sf_dir).select(F.regexp_replace(text, '"properties"', '"geometry":null,"properties"').alias("f")))
    f = readers.read_features(spark, folder, format="geojson")
    return f.select("feature_id", F.col("declared_bounds.minx").alias("d_minx"), F.col("declared_bounds.maxy").alias("d_maxy"))


_KINDS = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection")


@query(f"""WITH {PARCELS}, k AS (SELECT *, list_extract({list(_KINDS)!r}, (id % 7 + 1)::INT) AS kind FROM parcels)
  SELECT id::VARCHAR AS feature_id, kind, CASE id % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 10 ELSE 3 END::INT AS positions, CASE id % 7 WHEN 6 THEN 2 ELSE 1 END::INT AS members,
  minx, CASE id % 7 WHEN 0 THEN minx WHEN 3 THEN maxx + 1 WHEN 5 THEN maxx + 1 ELSE maxx END AS maxx, CASE id % 7 WHEN 0 THEN miny WHEN 3 THEN maxy + 1 WHEN 5 THEN maxy + 1 ELSE maxy END AS maxy FROM k""")
def geojson_kinds(spark, sf_dir):
    """Features of every kind, collections among them; a collection is flattened into members with their paths."""
    n = lambda c: F.col(c).cast("string")
    a, b = F.concat(F.lit("["), n("minx"), F.lit(","), n("miny"), F.lit("]")), F.concat(F.lit("["), n("maxx"), F.lit(","), n("maxy"), F.lit("]"))
    c = F.concat(F.lit("["), (F.col("maxx") + 1).cast("string"), F.lit(","), (F.col("maxy") + 1).cast("string"), F.lit("]"))
    corner = lambda x, y: F.concat(F.lit("["), n(x), F.lit(","), n(y), F.lit("]"))
    ring = F.concat(F.lit("["), F.concat_ws(",", a, corner("maxx", "miny"), b, corner("minx", "maxy"), a), F.lit("]"))
    more = F.concat(F.lit("["), F.concat_ws(",", b, c, b, c, b), F.lit("]"))
    listed = lambda *x: F.concat(F.lit("["), F.concat_ws(",", *x), F.lit("]"))
    shapes = [a, listed(a, b), listed(a, b), listed(listed(a, b), listed(b, c)), listed(ring), listed(listed(ring), listed(more))]
    kind, k = F.element_at(F.array(*[F.lit(x) for x in _KINDS]), (F.col("id") % 7 + 1).cast("int")), F.col("id") % 7
    coordinates = F.lit("")
    for i, shape in enumerate(shapes):
        coordinates = F.when(k == i, shape).otherwise(coordinates)
    simple = F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit("}"))
    whole = F.concat(F.lit('{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":'), a, F.lit('},{"type":"GeometryCollection","geometries":[{"type":"LineString","coordinates":'), listed(a, b), F.lit("}]}]}"))
    text = F.concat(F.lit('{"type":"Feature","id":'), n("id"), F.lit(',"geometry":'), F.when(k == 6, whole).otherwise(simple), F.lit(',"properties":{}}'))
    f = readers.read_features(spark, _collections(parcels(spark, sf_dir).select(text.alias("f"))), format="geojson")
    positions = F.aggregate("geometry.members", F.lit(0), lambda acc, m: acc + F.size(F.flatten(F.flatten(m["parts"]))))
    return f.select("feature_id", F.col("geometry.type").alias("kind"), positions.alias("positions"), F.size("geometry.members").alias("members"), "minx", "maxx", "maxy")


@query(f"WITH {PLACES} SELECT event_type, x, y, value AS z FROM places")
def shapefile_scan(spark, sf_dir):
    folder = scratch(spark)
    writers.write_features(_points(spark, sf_dir, True, _dealt), folder, "shapefile", fields=[("event_type", "C", 20, 0), ("value", "N", 24, 6)])
    f = readers.read_features(spark, folder, format="shapefile")
    return f.select(_attribute("event_type", "string").alias("event_type"), F.col("minx").alias("x"), F.col("miny").alias("y"), F.col("geometry.members")[0]["parts"][0][0][0]["z"].alias("z"))


@query(f"WITH {VERTICES}, r AS (SELECT id, count(*) AS n, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM vertices GROUP BY id HAVING count(*) > 1) SELECT id, n::BIGINT AS n, minx, maxy FROM r WHERE minx <= 150 AND maxx >= 20 AND miny <= 8 AND maxy >= 3")
def shapefile_extent(spark, sf_dir):
    """Lines by extent: the boxes of the records choose, the positions decide."""
    folder = scratch(spark)
    writers.write_features(_lines(spark, sf_dir), folder, "shapefile", fields=[("id", "N", 18, 0), ("n", "I", 4, 0)])
    f = readers.read_features(spark, folder, format="shapefile", extent=(20.0, 3.0, 150.0, 8.0))
    return f.select(_attribute("id", "long").alias("id"), _attribute("n", "long").alias("n"), "minx", "maxy")


@query(f"WITH {PARCELS} SELECT id, 'Polygon' AS kind, 5::INT AS positions, minx, miny, maxx, maxy FROM parcels")
def shapefile_polygons(spark, sf_dir):
    folder = scratch(spark)
    writers.write_features(_boxes(spark, sf_dir, _dealt).select("id", "geometry"), folder, "shapefile", fields=[("id", "N", 18, 0)])
    f = readers.read_features(spark, folder, format="shapefile")
    return f.select(_attribute("id", "long").alias("id"), F.col("geometry.type").alias("kind"), F.size(F.flatten(F.flatten(F.col("geometry.members")[0]["parts"]))).alias("positions"), "minx", "miny", "maxx", "maxy")


@query(f"WITH {VERTICES} SELECT id, 'MultiPoint' AS kind, count(*)::INT AS points, min(x) AS minx, max(y) AS maxy FROM vertices GROUP BY id")
def shapefile_multipoint(spark, sf_dir):
    folder = scratch(spark)
    points = _geometry("MultiPoint", F.transform("coords", lambda c: F.array(F.array(c))))
    writers.write_features(routes(spark, sf_dir).select("id", points), folder, "shapefile", fields=[("id", "N", 18, 0)])
    f = readers.read_features(spark, folder, format="shapefile")
    return f.select(_attribute("id", "long").alias("id"), F.col("geometry.type").alias("kind"), F.size(F.col("geometry.members")[0]["parts"]).alias("points"), "minx", "maxy")


@query("SELECT n_nationkey AS id, n_name || ' çéñü' AS name FROM nation")
def dbf_code_page(spark, sf_dir):
    """Texts of a table in a code page of one byte a character, which the CPG file names."""
    folder = scratch(spark)
    nowhere = F.lit(None).cast(S.GEOMETRY).alias("geometry")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), nowhere, F.concat("n_name", F.lit(" çéñü")).alias("name"))
    writers.write_features(rows, folder, "shapefile", fields=[("id", "N", 18, 0), ("name", "C", 40, 0)], codec="cp1252", cpg="1252")
    f = readers.read_features(spark, folder, format="shapefile")
    return f.select(_attribute("id", "long").alias("id"), _attribute("name", "string").alias("name"))


@query("SELECT o_orderkey AS id, round(o_totalprice, 2) AS price, o_orderdate::DATE AS day, o_orderstatus AS status, o_orderkey % 2 = 0 AS even FROM orders")
def dbf_scan(spark, sf_dir):
    """Typed columns of a DBF table."""
    folder = scratch(spark)
    o = table(spark, sf_dir, "orders")
    nowhere = F.lit(None).cast(S.GEOMETRY).alias("geometry")
    rows = o.select(F.col("o_orderkey").alias("id"), nowhere, F.round("o_totalprice", 2).alias("price"), F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 2 == 0).alias("even"))
    writers.write_features(rows, folder, "shapefile", fields=[("id", "N", 18, 0), ("price", "N", 20, 2), ("day", "D", 8, 0), ("status", "C", 4, 0), ("even", "L", 1, 0)])
    out = readers.read_dbf(spark, folder)
    return out.filter("NOT deleted").select("id", F.col("price").cast("double").alias("price"), "day", "status", "even")


@query(f"WITH {PARCELS} SELECT id::VARCHAR AS feature_id, minx, maxy, p_name, p_size::BIGINT AS p_size FROM parcels")
def gpkg_scan(spark, sf_dir):
    folder = scratch(spark)
    writers.write_features(_boxes(spark, sf_dir), folder, "geopackage", columns=[("p_name", "TEXT"), ("p_size", "INTEGER")])
    f = readers.read_features(spark, folder, format="geopackage")
    return f.select("feature_id", "minx", "maxy", _attribute("p_name", "string").alias("p_name"), _attribute("p_size", "long").alias("p_size"))


@query(f"WITH {PARCELS} SELECT id::VARCHAR AS feature_id FROM parcels WHERE minx <= 40 AND maxx >= 0 AND miny <= 30 AND maxy >= -10")
def gpkg_extent(spark, sf_dir):
    """By the index of the layer alone."""
    folder = scratch(spark)
    writers.write_features(_boxes(spark, sf_dir), folder, "geopackage", columns=[("p_name", "TEXT"), ("p_size", "INTEGER")])
    return readers.read_features(spark, folder, format="geopackage", extent=BOX).select("feature_id")


def _decoded(df: DataFrame, decode) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [decode(x.as_py()) for x in b.column("data")]
            boxes = [G.bounds(g) or (None,) * 4 for g in found]
            n = [sum(1 for _ in G.positions(g)) for g in found]
            yield pa.record_batch([b.column("id"), pa.array([g and g["type"] for g in found], pa.string()), pa.array(n, pa.int32()), *(pa.array([x[k] for x in boxes], pa.float64()) for k in range(4))], names=["id", "kind", "positions", "minx", "miny", "maxx", "maxy"])

    return df.mapInArrow(run, "id long, kind string, positions int, minx double, miny double, maxx double, maxy double")


def _encoded(df: DataFrame, encode) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.record_batch([b.column("id"), pa.array([encode(writers._values(g.as_py())) for g in b.column("geometry")], pa.binary())], names=["id", "data"])

    return df.select("id", "geometry").mapInArrow(run, "id long, data binary")


_SHAPES = f"WITH {VERTICES}, {PARCELS} SELECT id, 'LineString' AS kind, count(*)::INT AS positions, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM vertices GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'Polygon', 5, minx, miny, maxx, maxy FROM parcels"


@query(_SHAPES)
def wkb_decode(spark, sf_dir):
    both = _lines(spark, sf_dir).select("id", "geometry").union(_boxes(spark, sf_dir).select("id", "geometry"))
    return _decoded(_encoded(both, G.to_wkb), G.wkb)


@query(_SHAPES)
def gpkg_blob_decode(spark, sf_dir):
    both = _lines(spark, sf_dir).select("id", "geometry").union(_boxes(spark, sf_dir).select("id", "geometry"))
    return _decoded(_encoded(both, lambda g: G.to_gpkg_blob(g, 4326)), lambda b: G.gpkg_blob(b)[0])


@query(f"WITH {PLACES} SELECT count(*)::BIGINT AS feature_count, 'Point' AS geometry_type, min(x) AS minx, max(y) AS maxy FROM places")
def geojson_metadata(spark, sf_dir):
    """Metadata of all files of a folder, summed up."""
    folder = scratch(spark)
    writers.write_features(_points(spark, sf_dir), folder, "geojson")
    m = readers.vector_layers(spark, folder, format="geojson")
    return m.agg(F.sum("feature_count").alias("feature_count"), F.min("geometry_type").alias("geometry_type"), F.min("bounds.minx").alias("minx"), F.max("bounds.maxy").alias("maxy"))


#: Pixel rows of one image file.
IMAGE_ROWS = 1024


def _written(spark, sf_dir, write) -> None:
    """The sample grid as images of IMAGE_ROWS rows, each written by a task: ``write(top, array (h, w))``."""

    def run(t):
        import numpy as np
        import pyarrow as pa

        py, px, sample = (t.column(c).to_numpy() for c in ("py", "px", "sample"))
        top = int(py[0]) // IMAGE_ROWS * IMAGE_ROWS
        a = np.zeros((int(py.max()) - top + 1, int(px.max()) + 1), np.uint8)
        a[py - top, px] = sample
        write(top, a)
        return pa.table({"top": pa.array([top], pa.int64())})

    pixels(spark, sf_dir).withColumn("file", F.floor(F.col("py") / IMAGE_ROWS)).groupBy("file").applyInArrow(run, "top long").count()


def _tiffs(spark, sf_dir, planes=None, **how) -> str:
    """A folder of gray GeoTIFFs of the sample grid, with an overview of half the size each; ``planes`` makes other bands of an array."""
    folder = scratch(spark)

    def write(top, a):
        images = [(a[..., None], 1), (a[::2, ::2, None], 1)] if planes is None else [(planes(a), 2)]
        tags = {geotiff.SCALE: (12, [10.0, 10.0, 0.0]), geotiff.TIEPOINT: (12, [0.0, 0.0, 0.0, 100.0, 200.0 - 10.0 * top, 0.0]), geotiff.GEOKEYS: (3, [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 3857]), geotiff.NODATA: (2, "0")}
        files.write(f"{folder}/grid-{top}.tif", geotiff.encode(images, tags=tags, **how))

    _written(spark, sf_dir, write)
    return folder


_FILES = f"files AS (SELECT top, least(h - top, {IMAGE_ROWS}) AS n FROM (SELECT h, unnest(range(0, h, {IMAGE_ROWS})) AS top FROM (SELECT (max(vec_id) + 1)::BIGINT AS h FROM embeddings)))"


@query(f"WITH {_FILES} SELECT top, 64 AS width, n::INT AS height, 1 AS band_count, '3857' AS code, 100::DOUBLE AS minx, (200 - 10 * top - 10 * n)::DOUBLE AS miny, 740::DOUBLE AS maxx, (200 - 10 * top)::DOUBLE AS maxy, 'BlackIsZero' AS color_model, true AS is_tiled, 0::DOUBLE AS nodata, 'Gray' AS color, 32 AS over_w, ((n + 1) // 2)::INT AS over_h, 2::DOUBLE AS decx, n / ((n + 1) // 2)::DOUBLE AS decy FROM files")
def geotiff_metadata(spark, sf_dir):
    """Size, bounds, bands and overview of every image of a folder."""
    m = readers.raster_layers(spark, _tiffs(spark, sf_dir, tile=16), format="geotiff")
    over, top = F.col("overviews")[0], F.regexp_extract("path", r"grid-(\d+)\.tif$", 1).cast("long").alias("top")
    return m.select(top, "width", "height", "band_count", "crs.code", "bounds.*", "color_model", "is_tiled", F.col("bands")[0]["nodata"].alias("nodata"), F.col("bands")[0]["color"].alias("color"), over["w"].alias("over_w"), over["h"].alias("over_h"), over["decx"].alias("decx"), over["decy"].alias("decy"))


@query(f"WITH {PIXELS} SELECT px, py::INT AS py, sample FROM pixels WHERE px // 16 BETWEEN 1 AND 2 AND py // 16 BETWEEN 3 AND 7")
def geotiff_tiles(spark, sf_dir):
    """Tiles that a window touches."""
    path = f"{_tiffs(spark, sf_dir, tile=16)}/grid-0.tif"
    return readers.pixels(readers.read_blocks(spark, path, window=(20, 50, 20, 70))).select("px", "py", F.col("r").alias("sample"))


@query(f"WITH {PIXELS} SELECT px, py::INT AS py, sample FROM pixels WHERE py // 7 BETWEEN 7 AND 17")
def geotiff_strips(spark, sf_dir):
    """Strips that a window touches."""
    path = f"{_tiffs(spark, sf_dir, strip_rows=7, compression=1)}/grid-0.tif"
    return readers.pixels(readers.read_blocks(spark, path, window=(20, 50, 20, 70))).select("px", "py", F.col("r").alias("sample"))


def _deep(a):
    """Three bands of 16 bits: the samples, their complement, and nothing."""
    import numpy as np

    a = a.astype(np.uint16)
    return np.dstack([a << 8 | 7, (255 - a) << 8 | 200, a * 0])


@query(f"WITH {PIXELS} SELECT px, py::INT AS py, sample AS r, 255 - sample AS g, 0 AS b, 255 AS a FROM pixels")
def geotiff_samples(spark, sf_dir):
    """Samples of 16 bits in a plane for each band, of all images of a folder."""
    folder = _tiffs(spark, sf_dir, _deep, tile=32, planar=True)
    out = None
    for path in files.expand(folder, (".tif",)):
        top = int(files.stem(path).rpartition("-")[2])
        part = readers.pixels(readers.read_blocks(spark, path)).withColumn("py", F.col("py") + top)
        out = part if out is None else out.union(part)
    return out


@query(f"WITH {PIXELS} SELECT ox AS px, oy AS py, sample FROM (SELECT unnest(range(8)) AS ox) JOIN pixels ON px = 2 * (2 + ((2 * ox + 1) * 20) // 16) JOIN (SELECT unnest(range(16)) AS oy) ON py = 2 * (5 + ((2 * oy + 1) * 40) // 32)")
def viewport_read(spark, sf_dir):
    """A viewport's window through the cache, asked for twice and read once."""
    import numpy as np

    from ..operators.viewport import ByteCache, ViewportReader

    path = f"{_tiffs(spark, sf_dir, tile=16)}/grid-0.tif"
    reader = ViewportReader(lambda p, layer, window, w, h, wanted: readers.read_window(p, window, w, h, wanted)[2], ByteCache(1 << 20))
    reader.read_latest(path, "raster", (4, 10, 40, 80), 8, 16)
    a = np.frombuffer(reader.read_latest(path, "raster", (4, 10, 40, 80), 8, 16), np.uint8).reshape(16, 8, 4)
    if reader.reads != 1:
        raise AssertionError("the second request wasn't served by the cache")
    return spark.createDataFrame([(x, y, int(a[y, x, 0])) for y in range(16) for x in range(8)], "px long, py long, sample int")


def _described(spark, folder: str, rows: DataFrame, suffix: str) -> DataFrame:
    """Pixels of the images of a folder, beside what the metadata of their file say."""
    top = F.regexp_extract("path", rf"grid-(\d+)\.{suffix}$", 1).cast("int")
    t = F.col("geotransform")
    m = readers.raster_layers(spark, folder, format="worldimage").select(top.alias("top"), "color_model", "band_count", (t["ox"] - t["b"] * top).alias("ox"))
    return rows.join(F.broadcast(m), "top").drop("top")  # a row for each file


@query(f"WITH {PIXELS} SELECT px, py::INT AS py, sample, 'RGB' AS color_model, 3 AS band_count, 50::DOUBLE AS ox FROM pixels")
def worldimage_read(spark, sf_dir):
    """PNGs with world files: metadata and pixels of all rows."""
    folder = scratch(spark)

    def write(top, a):
        import numpy as np

        files.write(f"{folder}/grid-{top}.png", worldimage.encode_png(np.dstack([a, a * 0, a * 0])))
        files.write(f"{folder}/grid-{top}.pgw", f"4\n-1.5\n0.75\n-2\n{52.375 + 0.75 * top!r}\n{80.25 - 2 * top!r}\n".encode())

    _written(spark, sf_dir, write)
    top = F.regexp_extract("path", r"grid-(\d+)\.png$", 1).cast("int")
    blocks = readers.read_images(spark, folder).withColumn("y", F.col("y") + top)
    px = readers.pixels(blocks).select("px", "py", F.col("r").alias("sample"))
    return _described(spark, folder, px.withColumn("top", (F.floor(F.col("py") / IMAGE_ROWS) * IMAGE_ROWS).cast("int")), "png")


@query("SELECT n_nationkey AS id, 8 * 8 AS pixels, true AS near, 'Gray' AS color_model FROM nation")
def jpeg_read(spark, sf_dir):
    """A JPEG with a gray square of its own for each nation, decoded by Spark's image source; lossy, so to a few steps of gray."""
    keys = [r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").limit(1000).collect()]
    folder = scratch(spark)
    # the driver's Java writes the image: nothing else here encodes JPEG
    image = spark._jvm.java.awt.image.BufferedImage(8 * len(keys), 8, 10)
    raster = image.getRaster()
    for k in range(len(keys)):
        for x in range(8):
            for y in range(8):
                raster.setSample(8 * k + x, y, 0, 10 * (k % 25))
    out = spark._jvm.java.io.ByteArrayOutputStream()
    spark._jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    files.write(f"{folder}/grid-0.jpg", bytes(out.toByteArray()))
    files.write(f"{folder}/grid-0.jgw", b"4\n-1.5\n0.75\n-2\n52.375\n80.25\n")
    ids = F.broadcast(spark.createDataFrame(list(enumerate(keys)), "k int, id long"))
    px = readers.pixels(readers.read_images(spark, folder)).withColumn("k", F.expr("px div 8").cast("int")).join(ids, "k")
    per = px.groupBy("id").agg(F.count("*").cast("int").alias("pixels"), F.max(F.abs(F.col("r") - 10 * (F.col("k") % 25)) <= 4).alias("near"))
    (model,) = readers.raster_layers(spark, folder, format="worldimage").select("color_model").first()
    return per.withColumn("color_model", F.lit(model))
