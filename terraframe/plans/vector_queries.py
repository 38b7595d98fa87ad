"""Queries on envelopes, layers, geometries, indexes and joins, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import envelope as E, geometry as G, probe as P
from ..operators import flatten, index, layers
from .registry import query
from .views import PARCELS, PLACES, VERTICES, parcels, places, routes, table

BOX = (0.0, -10.0, 40.0, 30.0)
_HIT = "minx <= 40 AND maxx >= 0 AND miny <= 30 AND maxy >= -10"


@query(f"WITH {PLACES} SELECT id, x, y FROM places WHERE x BETWEEN 0 AND 40 AND y BETWEEN -10 AND 30")
def point_in_extent(spark, sf_dir):
    return layers.point_in_extent(places(spark, sf_dir), BOX).select("id", "x", "y")


@query(f"WITH {PARCELS} SELECT id, minx, miny, maxx, maxy FROM parcels WHERE {_HIT}")
def extent_filter(spark, sf_dir):
    return layers.extent_filter(parcels(spark, sf_dir), BOX).select("id", *E.SIDES)


@query(f"""WITH {PARCELS} SELECT id FROM (SELECT id, CASE WHEN id % 3 = 0 THEN minx - 5 ELSE minx END AS minx, CASE WHEN id % 3 = 0 THEN miny - 5 ELSE miny END AS miny,
  CASE WHEN id % 3 = 0 THEN maxx - 5 ELSE maxx END AS maxx, CASE WHEN id % 3 = 0 THEN maxy - 5 ELSE maxy END AS maxy FROM parcels WHERE id % 7 <> 0 OR id % 3 = 0) WHERE {_HIT}""")
def extent_filter_declared_fallback(spark, sf_dir):
    """Every third parcel has no geometry but a declared box; some have neither."""
    p = parcels(spark, sf_dir)
    own = F.when((F.col("id") % 3 != 0) & (F.col("id") % 7 != 0), E.flat())
    five = F.lit(5.0)
    null = F.lit(None).cast("double")
    moved = F.struct((F.col("minx") - five).alias("minx"), (F.col("miny") - five).alias("miny"), (F.col("maxx") - five).alias("maxx"), (F.col("maxy") - five).alias("maxy"), null.alias("minz"), null.alias("maxz"))
    p = p.withColumn("bounds", own).withColumn("declared_bounds", F.when(F.col("id") % 3 == 0, moved))
    return layers.extent_filter_declared(p, BOX).select("id")


@query(f"WITH {PARCELS} SELECT id, CASE WHEN id % 5 = 0 THEN false WHEN id % 4 = 0 THEN minx + 30 <= maxx ELSE true END AS valid FROM parcels")
def envelope_valid(spark, sf_dir):
    """Every fifth envelope has a NaN side, every fourth is shifted past its end."""
    left = F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).when(F.col("id") % 4 == 0, F.col("minx") + 30).otherwise(F.col("minx"))
    return parcels(spark, sf_dir).select("id", E.is_valid(E.make(left, F.col("miny"), F.col("maxx"), F.col("maxy"))).alias("valid"))


@query(f"""WITH {PARCELS} SELECT id, CASE WHEN id % 2 = 0 THEN minx ELSE least(minx, -10) END AS minx, CASE WHEN id % 2 = 0 THEN miny ELSE least(miny, -10) END AS miny,
  CASE WHEN id % 2 = 0 THEN maxx ELSE greatest(maxx, 10) END AS maxx, CASE WHEN id % 2 = 0 THEN maxy ELSE greatest(maxy, 10) END AS maxy FROM parcels""")
def envelope_union(spark, sf_dir):
    """The union with a fixed box, which is invalid for even ids."""
    other = E.make(F.when(F.col("id") % 2 == 0, 50.0).otherwise(-10.0), F.lit(-10.0), F.lit(10.0), F.lit(10.0))
    return parcels(spark, sf_dir).select("id", E.union(E.flat(), other).alias("u")).select("id", "u.*")


@query(f"WITH {PLACES} SELECT min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM places")
def layer_extent(spark, sf_dir):
    return layers.extent(places(spark, sf_dir))


@query("SELECT event_type AS layer, count(*)::BIGINT AS feature_count FROM events GROUP BY event_type")
def layer_count(spark, sf_dir):
    return places(spark, sf_dir).groupBy(F.col("event_type").alias("layer")).agg(F.count("*").alias("feature_count"))


@query("""SELECT p_brand AS layer, CASE WHEN min(k) = max(k) THEN min(k) END AS geometry_type
  FROM (SELECT p_brand, CASE WHEN p_size > 25 THEN 'Polygon' WHEN p_brand < 'Brand#3' THEN 'Polygon' WHEN p_size > 10 THEN 'Point' END AS k FROM part) GROUP BY p_brand""")
def layer_geometry_type(spark, sf_dir):
    kind = F.when(F.col("p_size") > 25, "Polygon").when(F.col("p_brand") < "Brand#3", "Polygon").when(F.col("p_size") > 10, "Point")
    return parcels(spark, sf_dir).groupBy(F.col("p_brand").alias("layer")).agg(G.uniform_kind(kind).alias("geometry_type"))


@query(f"WITH {PLACES} SELECT event_type AS layer, count(*)::BIGINT AS feature_count, 'Point' AS geometry_type, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM places GROUP BY event_type")
def layer_metadata(spark, sf_dir):
    p = places(spark, sf_dir).withColumns({"layer": F.col("event_type"), "kind": F.lit("Point")})
    return layers.metadata(p, ["layer"])


@query(f"WITH {VERTICES} SELECT id, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM vertices GROUP BY id")
def geometry_bounds(spark, sf_dir):
    return routes(spark, sf_dir).select("id", E.of_coords(F.col("coords")).alias("b")).select("id", "b.*")


@query(f"WITH {VERTICES} SELECT id // 10 AS id, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM vertices GROUP BY id // 10")
def part_bounds(spark, sf_dir):
    """Bounds of lines with many parts: ten orders make one."""
    lines = routes(spark, sf_dir).groupBy(F.expr("id div 10").alias("id")).agg(F.collect_list(F.array("coords")).alias("parts"))
    return lines.select("id", E.of_parts(F.col("parts")).alias("b")).select("id", "b.*")


@query(f"""WITH {VERTICES}, o AS (SELECT id, x, y, row_number() OVER (PARTITION BY id ORDER BY n, x, y) AS k, count(*) OVER (PARTITION BY id) AS c FROM vertices),
  e AS (SELECT id, c, bool_or(k = 1 AND x < 500) AS f FROM o GROUP BY id, c) SELECT id, (c + (CASE WHEN f THEN 1 ELSE 0 END) >= 4 AND (f OR c = 1 OR EXISTS (SELECT 1 FROM o a JOIN o b ON a.id = b.id AND a.x = b.x AND a.y = b.y WHERE a.id = e.id AND a.k = 1 AND b.k = e.c))) AS valid FROM e""")
def ring_validate(spark, sf_dir):
    """Routes as rings: those that begin west of 500 are closed by repeating the first position."""
    ring = F.when(F.col("coords")[0]["x"] < 500, F.concat("coords", F.slice("coords", 1, 1))).otherwise(F.col("coords"))
    return routes(spark, sf_dir).select("id", G.ring_valid(ring).alias("valid"))


@query(f"WITH {VERTICES} SELECT id, count(*) <> 1 AS valid FROM vertices GROUP BY id")
def linestring_validate(spark, sf_dir):
    return routes(spark, sf_dir).select("id", G.line_valid(F.col("coords")).alias("valid"))


@query("SELECT vec_id AS id, vec_id % 5 IN (2, 3) AND vec_id % 7 <> 0 AS valid FROM embeddings")
def position_validate(spark, sf_dir):
    """The first numbers of a vector as a position of 0 to 4 ordinates, some with a NaN."""
    e = table(spark, sf_dir, "embeddings")
    cut = F.slice(F.transform("embedding", lambda v, i: F.when((F.col("vec_id") % 7 == 0) & (i == 0), F.lit(float("nan"))).otherwise(v.cast("double"))), F.lit(1), (F.col("vec_id") % 5).cast("int"))
    return e.select(F.col("vec_id").alias("id"), G.position_valid(cut).alias("valid"))


_NAMES = "POINT,linestring,Polygon,MULTIPOINT,GEOMCOLLECTION,GEOMETRY"


@query(f"""SELECT p_partkey AS id, CASE upper(list_extract(string_split('{_NAMES}', ','), (p_partkey % 6 + 1)::INT)) WHEN 'POINT' THEN 'Point' WHEN 'LINESTRING' THEN 'LineString' WHEN 'POLYGON' THEN 'Polygon'
  WHEN 'MULTIPOINT' THEN 'MultiPoint' WHEN 'GEOMCOLLECTION' THEN 'GeometryCollection' END AS named,
  CASE p_size WHEN 1 THEN 'Point' WHEN 11 THEN 'Point' WHEN 21 THEN 'Point' WHEN 3 THEN 'MultiLineString' WHEN 13 THEN 'MultiLineString' WHEN 23 THEN 'MultiLineString'
  WHEN 5 THEN 'Polygon' WHEN 15 THEN 'Polygon' WHEN 25 THEN 'Polygon' WHEN 8 THEN 'MultiPoint' WHEN 18 THEN 'MultiPoint' WHEN 28 THEN 'MultiPoint' END AS shape FROM part""")
def geometry_kind(spark, sf_dir):
    name = F.element_at(F.split(F.lit(_NAMES), ","), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), G.named_kind(name).alias("named"), G.shape_kind(F.col("p_size")).alias("shape"))


@query(f"WITH {PLACES} SELECT id FROM places WHERE event_type = 'click'")
def layer_select(spark, sf_dir):
    return layers.select_layer(places(spark, sf_dir).withColumn("layer", F.col("event_type")), "click").select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 11 <> 0")
def deleted_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 11 == 0).alias("deleted"))
    return layers.live_rows(o).select("id")


@query("SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN l_tax * 100 >= 7 OR l_quantity < 3 THEN NULL ELSE l_quantity END AS m FROM lineitem")
def measure_normalise(spark, sf_dir):
    m = F.when(F.col("l_tax") * 100 >= 7, F.lit(-1e39)).when(F.col("l_quantity") < 2, F.lit(float("nan"))).when(F.col("l_quantity") < 3, F.lit(float("inf"))).otherwise(F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), G.measure(m).alias("m"))


@query(f"""WITH {VERTICES}, {PARCELS}, {PLACES}, r AS (SELECT id, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy, count(*) AS n FROM vertices GROUP BY id)
  SELECT 'Polyline' AS kind, id, minx, miny, maxx, maxy, n::INT AS positions FROM r WHERE minx <= 300 AND maxx >= 100 AND miny <= 300 AND maxy >= 5
  UNION ALL SELECT 'Polygon', id, minx, miny, maxx, maxy, 5 FROM parcels WHERE minx <= 300 AND maxx >= 100 AND miny <= 300 AND maxy >= 5
  UNION ALL SELECT 'Point', id, x, y, x, y, 1 FROM places WHERE x BETWEEN 100 AND 300 AND y BETWEEN 5 AND 300""")
def render_frame(spark, sf_dir):
    """Routes, parcels and places as one layer of mixed geometries, flattened for a view."""
    none, noint = F.lit(None).cast("double"), F.array().cast("array<int>")
    coord = lambda x, y: F.struct(x.alias("x"), y.alias("y"), none.alias("z"), none.alias("m"))
    box = "struct<minx:double,miny:double,maxx:double,maxy:double,minz:double,maxz:double>"

    def geometry(kind: str, coords):
        member = F.struct(noint.alias("path"), F.lit(kind).alias("type"), F.lit(None).cast(box).alias("declared"), F.array(F.array(coords)).alias("parts"))
        return F.struct(F.lit(kind).alias("type"), F.array(member).alias("members")).alias("geometry")

    corner = lambda x, y: coord(F.col(x), F.col(y))
    ring = F.array(corner("minx", "miny"), corner("maxx", "miny"), corner("maxx", "maxy"), corner("minx", "maxy"), corner("minx", "miny"))
    lines = routes(spark, sf_dir).select("id", geometry("LineString", F.col("coords")))
    boxes = parcels(spark, sf_dir).select("id", geometry("Polygon", ring))
    points = places(spark, sf_dir).select("id", geometry("Point", F.array(corner("x", "y"))))
    empty = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), geometry("LineString", F.array().cast("array<struct<x:double,y:double,z:double,m:double>>")))
    frame = flatten.render_frame(lines.union(boxes).union(points).union(empty), (100.0, 5.0, 300.0, 300.0))
    return frame.select("kind", "id", *E.SIDES, F.size(F.flatten("rings")).alias("positions"))


@query(f"WITH {PARCELS} SELECT id, minx, miny, maxx, maxy, (minx + maxx) / 2 AS cx, (miny + maxy) / 2 AS cy FROM parcels")
def index_build(spark, sf_dir):
    return index.build(parcels(spark, sf_dir), "id")


@query(f"WITH {PARCELS} SELECT id FROM parcels WHERE {_HIT}")
def index_query(spark, sf_dir):
    return index.query(index.build(parcels(spark, sf_dir), "id"), BOX).select("id")


@query(f"WITH {PARCELS} SELECT id, row_number() OVER (ORDER BY (minx + maxx) / 2, (miny + maxy) / 2, id)::BIGINT AS rank FROM parcels WHERE {_HIT}")
def index_sort(spark, sf_dir):
    """The packing order of the entries that meet the extent: counts before each unit of centre X, and ranks within it."""
    from pyspark.sql import Window

    hits = index.query(index.build(parcels(spark, sf_dir), "id"), BOX).withColumn("unit", F.floor("cx"))
    sizes = hits.groupBy("unit").agg(F.count("*").alias("n"))
    before = sizes.select("unit", (F.sum("n").over(Window.orderBy("unit")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("unit").orderBy("cx", "cy", "id"))
    return hits.withColumn("rank", rank).join(before, "unit").select("id", (F.col("before") + F.col("rank")).cast("long").alias("rank"))


@query(f"WITH {PARCELS} SELECT id, p_name FROM parcels WHERE id % 4 <> 0 AND {_HIT}")
def rtree_join(spark, sf_dir):
    """Features whose index row meets the extent; features that aren't indexed don't match."""
    p = parcels(spark, sf_dir)
    entries = index.build(p.filter("id % 4 <> 0").select(F.col("id").alias("entry"), *E.SIDES), "entry")
    return index.join(p, entries, "id", "entry", BOX).select("id", "p_name")


@query(f"WITH {PARCELS} SELECT id AS record_no FROM parcels WHERE {_HIT} AND minx + 1 <= 40 AND maxx - 1 >= 0")
def candidate_search(spark, sf_dir):
    """Declared boxes choose candidates, actual bounds refine them; in order of record number."""
    p = parcels(spark, sf_dir)
    candidates = index.query(index.build(p, "id"), BOX).select(F.col("id").alias("record_no"))
    real = p.select(F.col("id").alias("record_no"), (F.col("minx") + 1).alias("minx"), "miny", (F.col("maxx") - 1).alias("maxx"), "maxy")
    real = real.filter((F.col("minx") <= BOX[2]) & (F.col("maxx") >= BOX[0]) & (F.col("miny") <= BOX[3]) & (F.col("maxy") >= BOX[1]))
    return candidates.join(real, "record_no", "left_semi").orderBy("record_no")


@query(f"WITH {PARCELS} SELECT id AS record_no, minx, miny, p_name FROM parcels")
def positional_join(spark, sf_dir):
    p = parcels(spark, sf_dir).withColumnRenamed("id", "record_no")
    return index.positional_join(p.select("record_no", "minx", "miny"), p.select("record_no", "p_name"))


@query("SELECT (SELECT count(*) FROM orders)::BIGINT AS shapes, (SELECT count(DISTINCT l_orderkey) FROM lineitem)::BIGINT AS attributes, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))::BIGINT AS unmatched")
def positional_check(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_no"))
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_no")).distinct()
    return index.positional_check(a, b)


@query("SELECT n_name AS table_name, n_nationkey::INT AS srs_id, r_name AS organization FROM nation LEFT JOIN region ON n_nationkey = r_regionkey WHERE n_nationkey % 3 <> 0")
def gpkg_catalog(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    columns = n.select(F.col("n_name").alias("table_name"), F.col("n_nationkey").cast("int").alias("srs_id"))
    contents = n.select(F.col("n_name").alias("table_name"), F.when(F.col("n_nationkey") % 3 != 0, "features").otherwise("tiles").alias("data_type"), F.col("n_nationkey").alias("srs_id"))
    systems = r.select(F.col("r_regionkey").cast("int").alias("srs_id"), F.col("r_name").alias("organization"))
    return index.catalog(columns, contents, systems).select("table_name", "srs_id", "organization")


@query("SELECT l_orderkey::VARCHAR AS table_name, arg_min(l_partkey::VARCHAR, k) AS key FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice) - 2 AS k FROM lineitem) WHERE k > 0 GROUP BY 1")
def pk_select(spark, sf_dir):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_extendedprice")) - 2
    columns = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("table_name"), F.col("l_partkey").cast("string").alias("name"), rank.alias("pk"))
    return index.primary_key(columns)


@query(f"""WITH {PLACES}, {PARCELS} SELECT a.id AS l_id, b.id AS r_id FROM places a JOIN parcels b ON a.x <= b.maxx AND a.x >= b.minx AND a.y <= b.maxy AND a.y >= b.miny""")
def spatial_join_whole(spark, sf_dir):
    """Beyond the reference: all places with the parcels they lie in."""
    p = parcels(spark, sf_dir).select("id", *E.SIDES)
    return index.spatial_join(places(spark, sf_dir).select("id", *E.SIDES), p, 5.0).select("l_id", "r_id")


@query(f"""WITH {PARCELS} SELECT a.id AS l_id, b.id AS r_id FROM parcels a JOIN parcels b ON a.p_size < 6 AND b.p_size > 40 AND a.minx <= b.maxx AND a.maxx >= b.minx AND a.miny <= b.maxy AND a.maxy >= b.miny""")
def spatial_join(spark, sf_dir):
    """Beyond the reference: small parcels with the large ones they meet; ``spatial_join_whole`` joins two whole tables."""
    p = parcels(spark, sf_dir).select("id", *E.SIDES, "p_size")
    return index.spatial_join(p.filter("p_size < 6"), p.filter("p_size > 40"), 12.5).select("l_id", "r_id")


@query("SELECT event_id AS id, least(greatest(event_id, 100), 5000)::BIGINT AS seq FROM events")
def result_order(spark, sf_dir):
    """Rows carry their place in the file; order is asked for when it is needed."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.least(F.greatest(F.col("event_id"), F.lit(100)), F.lit(5000)).cast("long").alias("seq"))
    return e.orderBy("seq", "id")


_EXT = ".geojson,.JSON,.shp,.shx,.gpkg,.tif,.TIFF,.png,.jpg,.Jpeg,.txt,"


@query(f"""WITH f AS (SELECT event_id, 'dir.x/f' || event_id || list_extract(string_split('{_EXT}', ','), (event_id % 12 + 1)::INT) AS path, lower(list_extract(string_split('{_EXT}', ','), (event_id % 12 + 1)::INT)) AS e FROM events)
  SELECT event_id, path, CASE WHEN e IN ('.geojson', '.json') THEN 'geojson' WHEN e = '.shp' THEN 'shapefile' WHEN e = '.gpkg' THEN 'geopackage' WHEN e IN ('.tif', '.tiff') THEN 'geotiff' WHEN e IN ('.png', '.jpg', '.jpeg') THEN 'worldimage' END AS format,
  CASE WHEN e IN ('.geojson', '.shp', '.gpkg') THEN 100 WHEN e = '.json' THEN 50 WHEN e IN ('.tif', '.tiff') THEN 90 WHEN e IN ('.png', '.jpg', '.jpeg') THEN 70 ELSE 0 END AS confidence, e NOT IN ('.shx', '.txt', '') AS is_match FROM f""")
def probe_format(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ext = F.element_at(F.split(F.lit(_EXT), ",", -1), (F.col("event_id") % 12 + 1).cast("int"))
    path = F.concat(F.lit("dir.x/f"), F.col("event_id").cast("string"), ext)
    return e.select("event_id", path.alias("path"), P.probe(path).alias("p")).select("event_id", "path", "p.format", "p.confidence", "p.is_match")
