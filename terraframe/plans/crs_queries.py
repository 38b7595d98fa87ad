"""Queries on reference systems, with the SQL that gives the same rows. Results of transcendental functions are rounded."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import crs as C
from .registry import query
from .views import PLACES, places, table

_X = "6378137::DOUBLE * radians(x)"
_Y = "6378137::DOUBLE * ln(tan(pi() / 4 + radians(y) / 2))"


@query(f"WITH {PLACES} SELECT id, round({_X}, 6) AS mx, round({_Y}, 6) + 0::DOUBLE AS my FROM places")
def to_web_mercator(spark, sf_dir):
    p = places(spark, sf_dir)
    mx, my = C.to_mercator(F.col("x"), F.col("y"))
    return p.select("id", F.round(mx, 6).alias("mx"), (F.round(my, 6) + 0.0).alias("my"))


@query(f"WITH {PLACES} SELECT id, round(degrees(x * 1000 / 6378137), 9) AS lon, round(degrees(2 * atan(exp(y * 1000 / 6378137)) - pi() / 2), 9) AS lat FROM places")
def from_web_mercator(spark, sf_dir):
    lon, lat = C.from_mercator(F.col("x") * 1000, F.col("y") * 1000)
    return places(spark, sf_dir).select("id", F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


@query(f"WITH {PLACES} SELECT id, round({_X}, 6) AS mx, round({_Y}, 6) + 0::DOUBLE AS my, y AS first, x AS second FROM places")
def axis_order(spark, sf_dir):
    """Latitude comes first on the geographic side when the authority's order is kept."""
    p = places(spark, sf_dir).select("id", F.col("y").alias("first"), F.col("x").alias("second"))
    mx, my = C.to_mercator(F.col("first"), F.col("second"), C.COMPLIANT)
    return p.select("id", F.round(mx, 6).alias("mx"), (F.round(my, 6) + 0.0).alias("my"), "first", "second")


@query(f"WITH {PLACES} SELECT id, round({_X}, 6) AS mx, round({_Y}, 6) + 0::DOUBLE AS my, value AS z, NULL::DOUBLE AS m FROM places")
def transform_coords(spark, sf_dir):
    coord = F.struct("x", "y", F.col("value").alias("z"), F.lit(None).cast("double").alias("m"))
    moved = C.transform_coords(F.array(coord), 4326, 3857)[0]
    return places(spark, sf_dir).select("id", moved.alias("c")).select("id", F.round("c.x", 6).alias("mx"), (F.round("c.y", 6) + 0.0).alias("my"), "c.z", "c.m")


@query(f"""WITH {PLACES} SELECT id, round(CASE id % 3 WHEN 0 THEN {_X} WHEN 1 THEN degrees(x * 1000 / 6378137) ELSE x END, 6) + 0::DOUBLE AS tx,
  round(CASE id % 3 WHEN 0 THEN {_Y} WHEN 1 THEN degrees(2 * atan(exp(y * 1000 / 6378137)) - pi() / 2) ELSE y END, 6) + 0::DOUBLE AS ty FROM places""")
def transform_records(spark, sf_dir):
    """Every row's own record says where its position comes from: degrees, metres, or an unknown system that is asked for itself."""
    k = F.col("id") % 3
    site = C.make(None, None, None, F.concat(F.lit("site "), F.col("id").cast("string")))
    wgs = C.parse_wkt(F.concat(F.lit('GEOGCS["World",DATUM["D",SPHEROID["S",6378137,298.25]],AUTHORITY["EPSG","4326"]]')))
    source = F.when(k == 0, wgs).when(k == 1, C.from_epsg(F.lit(3857))).otherwise(site)
    target = F.when(k == 0, C.from_epsg(F.lit(3857))).when(k == 1, C.from_epsg(F.lit(4326))).otherwise(site)
    scale = F.when(k == 1, 1000.0).otherwise(1.0)
    none = F.lit(None).cast("double")
    coord = F.struct((F.col("x") * scale).alias("x"), (F.col("y") * scale).alias("y"), none.alias("z"), none.alias("m"))
    p = places(spark, sf_dir).select("id", F.array(coord).alias("c"), source.alias("source"), target.alias("target"))
    return p.select("id", C.transform_coords(F.col("c"), F.col("source"), F.col("target"))[0].alias("t")).select("id", (F.round("t.x", 6) + 0.0).alias("tx"), (F.round("t.y", 6) + 0.0).alias("ty"))


@query(f"WITH {PLACES} SELECT id, round(x, 9) AS x, round(y, 9) AS y FROM places")
def round_trip(spark, sf_dir):
    """There and back again, to nine decimals of a degree."""
    mx, my = C.to_mercator(F.col("x"), F.col("y"))
    lon, lat = C.from_mercator(mx, my)
    return places(spark, sf_dir).select("id", F.round(lon, 9).alias("x"), F.round(lat, 9).alias("y"))


_WKT = """CASE WHEN o_orderkey % 4 = 0 THEN 'GEOGCS["W ' || o_orderkey || '",AUTHORITY["EPSG","4326"]]' WHEN o_orderkey % 4 = 1 THEN 'PROJCRS["P",BASEGEOGCRS["B",ID["EPSG",4326]],id [ "EPSG" , ' || (3000 + o_orderkey % 1000) || ']]'
  WHEN o_orderkey % 4 = 2 THEN 'LOCAL_CS["Site ' || o_orderkey || '"]' ELSE 'GEOGCS["G",AUTHORITY["ESRI","' || o_orderkey || '"]]' END"""


def _systems(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_WKT).alias("wkt"))


_PARSED = f"""w AS (SELECT o_orderkey AS id, {_WKT} AS wkt FROM orders),
p AS (SELECT id, wkt, CASE WHEN id % 4 = 0 THEN 'EPSG' WHEN id % 4 = 1 THEN 'EPSG' WHEN id % 4 = 3 THEN 'ESRI' END AS authority,
 CASE WHEN id % 4 = 0 THEN '4326' WHEN id % 4 = 1 THEN (3000 + id % 1000)::VARCHAR WHEN id % 4 = 3 THEN id::VARCHAR END AS code, nullif(regexp_extract(wkt, '^[A-Za-z0-9_]+\\s*\\[\\s*"([^"]+)"', 1), '') AS name FROM w)"""


@query(f"WITH {_PARSED} SELECT id, authority, code, name FROM p")
def wkt_parse(spark, sf_dir):
    return _systems(spark, sf_dir).select("id", C.parse_wkt(F.col("wkt")).alias("c")).select("id", "c.authority", "c.code", "c.name")


@query(f"WITH {_PARSED} SELECT id, CASE WHEN authority = 'EPSG' THEN code::INT END AS epsg FROM p")
def crs_epsg(spark, sf_dir):
    s = _systems(spark, sf_dir)
    return s.select("id", C.epsg(C.make(None, None, F.col("wkt"), None)).alias("epsg"))


@query(f"WITH {_PARSED} SELECT id, id % 4 = 0 OR (id % 4 = 1 AND id % 1000 = 857) OR id % 5 = 0 AS possible FROM p")
def can_transform(spark, sf_dir):
    """To Web Mercator, or to WGS 84 from it; every fifth system is asked about itself."""
    s = _systems(spark, sf_dir)
    own = C.parse_wkt(F.col("wkt"))
    mercator, wgs = C.from_epsg(F.lit(3857)), C.from_epsg(F.lit(4326))
    target = F.when(F.col("id") % 5 == 0, own).when(C.epsg(own) == 3857, wgs).otherwise(mercator)
    return s.select("id", C.can_transform(own, target).alias("possible"))


@query("SELECT o_orderkey AS id, o_orderkey % 4 = 0 OR o_orderkey % 4 = 1 AS unknown FROM orders")
def crs_unknown(spark, sf_dir):
    """A system without anything or with just a name is unknown; one with an authority or a text isn't."""
    null = F.lit(None).cast("string")
    k = F.col("o_orderkey") % 4
    crs = F.struct(F.when(k == 2, "NONE").alias("authority"), null.alias("code"), F.when(k == 3, "X[]").when(k == 0, " ").alias("wkt"), F.when(k == 1, "somewhere").alias("name"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), C.is_unknown(crs).alias("unknown"))


@query("SELECT o_orderkey AS id, 'EPSG' AS authority, o_orderkey::VARCHAR AS code, 'EPSG:' || o_orderkey AS name FROM orders")
def crs_from_epsg(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), C.from_epsg(F.col("o_orderkey")).alias("c")).select("id", "c.authority", "c.code", "c.name")


@query("""SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 <> 0 THEN n_name END AS authority, CASE WHEN n_nationkey > 5 THEN (n_nationkey - 5)::VARCHAR END AS code,
  CASE WHEN n_nationkey % 3 = 0 THEN 'GEOGCS["x"]' END AS wkt, n_name AS name FROM nation""")
def gpkg_crs(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    text = F.when(F.col("n_nationkey") % 3 == 0, 'GEOGCS["x"]').when(F.col("n_nationkey") % 3 == 1, "undefined").otherwise(" ")
    crs = C.of_gpkg(F.when(F.col("n_nationkey") % 5 != 0, F.col("n_name")).otherwise(""), F.col("n_nationkey") - 5, text, F.col("n_name"))
    return n.select(F.col("n_nationkey").alias("id"), crs.alias("c")).select("id", "c.*")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 2 THEN 'EPSG' END AS authority, CASE WHEN o_orderkey % 3 <> 2 THEN o_orderkey::VARCHAR END AS code,
  CASE o_orderkey % 3 WHEN 0 THEN 'epsg:' || o_orderkey WHEN 1 THEN 'urn:ogc:def:crs:EPSG::' || o_orderkey ELSE 'urn:ogc:def:crs:OGC:1.3:CRS84' END AS name FROM orders""")
def geojson_crs(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("epsg:"), k)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("urn:ogc:def:crs:EPSG::"), k)).otherwise("urn:ogc:def:crs:OGC:1.3:CRS84")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), C.named(name).alias("c")).select("id", "c.authority", "c.code", "c.name")
