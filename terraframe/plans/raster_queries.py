"""Queries on raster grids, caches and requests, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import raster as R
from ..operators import rasters, viewport
from .registry import query
from .views import PIXELS, PLACES, pixels, places, table

#: An affine transform with rotation, as Spark columns and in SQL.
_T = (100.0, 2.0, 0.25, 200.0, -0.5, -3.0)


def _affine():
    return R.affine(*[F.lit(v) for v in _T])


@query(f"WITH {PLACES} SELECT id, 100 + x * 2 + y * 0.25::DOUBLE AS wx, 200 + x * -0.5::DOUBLE + y * -3 AS wy FROM places")
def pixel_to_world(spark, sf_dir):
    x, y = R.pixel_to_world(_affine(), F.col("x"), F.col("y"))
    return places(spark, sf_dir).select("id", x.alias("wx"), y.alias("wy"))


@query(f"""WITH {PLACES} SELECT id, CASE WHEN id % 10 <> 0 THEN round((-3 * (x - 100) - 0.25::DOUBLE * (y - 200)) / -5.875::DOUBLE, 9) END AS col, CASE WHEN id % 10 <> 0 THEN round((2 * (y - 200) + 0.5::DOUBLE * (x - 100)) / -5.875::DOUBLE, 9) END AS row FROM places""")
def world_to_pixel(spark, sf_dir):
    """Every tenth transform can't be inverted."""
    t = R.affine(F.lit(100.0), F.lit(2.0), F.lit(0.25), F.lit(200.0), F.when(F.col("id") % 10 == 0, -24.0).otherwise(-0.5), F.lit(-3.0))
    return places(spark, sf_dir).select("id", R.world_to_pixel(t, F.col("x"), F.col("y")).alias("p")).select("id", F.round("p.col", 9).alias("col"), F.round("p.row", 9).alias("row"))


@query("""SELECT id, least(ox, ox + w * 2, ox + h, ox + w * 2 + h) AS minx, least(oy, oy + w * 0.5, oy - h * 2, oy + w * 0.5 - h * 2) AS miny, greatest(ox, ox + w * 2, ox + h, ox + w * 2 + h) AS maxx, greatest(oy, oy + w * 0.5, oy - h * 2, oy + w * 0.5 - h * 2) AS maxy
  FROM (SELECT p_partkey AS id, p_size::DOUBLE AS w, (p_partkey % 30)::DOUBLE AS h, (p_partkey % 100)::DOUBLE AS ox, 10::DOUBLE AS oy FROM part)""")
def raster_bounds(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    t = R.affine(F.col("p_partkey") % 100, F.lit(2.0), F.lit(1.0), F.lit(10.0), F.lit(0.5), F.lit(-2.0))
    return p.select(F.col("p_partkey").alias("id"), R.bounds(t, F.col("p_size").cast("double"), (F.col("p_partkey") % 30).cast("double")).alias("b")).select("id", "b.*")


_WIN = "SELECT p_partkey AS id, (p_partkey % 50)::INT AS x, (p_partkey % 37 - 3)::INT AS y, p_size::INT AS w, (p_size * 2)::INT AS h FROM part"


def _windows(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 50).alias("x"), (F.col("p_partkey") % 37 - 3).alias("y"), F.col("p_size").alias("w"), (F.col("p_size") * 2).alias("h"))
    return p.select("id", R.window(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("v"))


@query(f"""WITH v AS ({_WIN}), c AS (SELECT id, x, y, least(x + w, 60) - x AS w, least(y + h, 40) - y AS h, y >= 0 AS ok FROM v)
  SELECT id, CASE WHEN ok AND w > 0 AND h > 0 THEN x END AS x, CASE WHEN ok AND w > 0 AND h > 0 THEN y END AS y, CASE WHEN ok AND w > 0 AND h > 0 THEN w END AS w, CASE WHEN ok AND w > 0 AND h > 0 THEN h END AS h FROM c""")
def raster_window_clip(spark, sf_dir):
    return _windows(spark, sf_dir).select("id", R.clip(F.col("v"), F.lit(60), F.lit(40)).alias("c")).select("id", "c.x", "c.y", "c.w", "c.h")


@query("""SELECT p_partkey AS id, l AS level, (1000 / w)::DOUBLE AS decx, (800 / h)::DOUBLE AS decy FROM part, (VALUES (1, 500, 400), (2, 1000, 100), (3, 250, 900), (4, 125, 100)) o(l, w0, h0), LATERAL (SELECT w0 - p_size AS w, h0 - p_size AS h) WHERE w < 1000 AND h < 800""")
def overview_list(spark, sf_dir):
    level = lambda k, w, h: F.struct(F.lit(k).alias("level"), (F.lit(w) - F.col("p_size")).alias("w"), (F.lit(h) - F.col("p_size")).alias("h"))
    levels = F.array(level(1, 500, 400), level(2, 1000, 100), level(3, 250, 900), level(4, 125, 100))
    out = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(R.overviews(F.lit(1000), F.lit(800), levels)).alias("o"))
    return out.select("id", "o.level", "o.decx", "o.decy")


@query("""SELECT p_partkey AS id, (CASE WHEN t >= 8 THEN 4 WHEN t >= 4 THEN 3 WHEN t >= 2 THEN 1 ELSE 0 END)::INT AS level FROM (SELECT p_partkey, greatest(1000 / (p_size * 10)::DOUBLE, 800 / (p_size * 9)::DOUBLE) AS t FROM part)""")
def overview_select(spark, sf_dir):
    """Of two overviews with the same decimation the later one is taken."""
    one = lambda k, x, y: F.struct(F.lit(k).alias("level"), F.lit(x).alias("decx"), F.lit(y).alias("decy"))
    levels = F.array(one(1, 2.0, 2.0), one(2, 4.0, 2.0), one(3, 4.0, 4.0), one(4, 8.0, 8.0))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), R.select_overview(F.lit(1000), F.lit(800), F.col("p_size") * 10, F.col("p_size") * 9, levels).cast("int").alias("level"))


@query(f"""WITH v AS ({_WIN}), m AS (SELECT id, least(greatest(floor(x / 2.5::DOUBLE), 0), 39)::INT AS l, least(greatest(floor(y / 3::DOUBLE), 0), 29)::INT AS t, x, y, w, h FROM v WHERE y >= 0),
  n AS (SELECT id, l, t, least(greatest(ceil((x + w) / 2.5::DOUBLE), l + 1), 40)::INT AS r, least(greatest(ceil((y + h) / 3::DOUBLE), t + 1), 30)::INT AS b FROM m) SELECT id, l AS x, t AS y, r - l AS w, b - t AS h FROM n""")
def overview_window_map(spark, sf_dir):
    v = _windows(spark, sf_dir).filter("v.y >= 0")
    return v.select("id", R.map_window(F.col("v"), F.lit(100), F.lit(90), F.lit(40), F.lit(30)).alias("m")).select("id", "m.*")


@query(f"WITH {PIXELS} SELECT (px // 16)::BIGINT AS tx, (py // 16)::BIGINT AS ty, count(*)::BIGINT AS n FROM pixels WHERE px // 16 BETWEEN 1 AND 2 AND py // 16 BETWEEN 3 AND 9 GROUP BY 1, 2")
def tile_prune(spark, sf_dir):
    tiles = pixels(spark, sf_dir).withColumns({"tx": F.expr("px div 16"), "ty": F.expr("py div 16")})
    return rasters.prune_tiles(tiles, (20, 50, 20, 100), 16, 16).groupBy("tx", "ty").agg(F.count("*").alias("n"))


@query(f"WITH {PIXELS} SELECT (py // 7)::BIGINT AS strip, count(*)::BIGINT AS n FROM pixels WHERE py // 7 BETWEEN 7 AND 21 GROUP BY 1")
def strip_prune(spark, sf_dir):
    strips = pixels(spark, sf_dir).withColumn("strip", F.expr("py div 7"))
    return rasters.prune_strips(strips, (0, 50, 64, 100), 7).groupBy("strip").agg(F.count("*").alias("n"))


@query(f"WITH {PIXELS} SELECT ox AS out_x, oy AS out_y, sample FROM (SELECT unnest(range(120)) AS ox) JOIN pixels ON px = least(63, ((2 * ox + 1) * 64) // 240) JOIN (SELECT unnest(range(24)) AS oy) ON py = least(199, ((2 * oy + 1) * 200) // 48)")
def resample_nearest(spark, sf_dir):
    return rasters.resample(pixels(spark, sf_dir), (0, 0, 64, 200), 120, 24, ["sample"])


@query(f"WITH {PIXELS}, half AS (SELECT px // 2 AS px, py // 2 AS py, min(sample) AS sample FROM pixels GROUP BY 1, 2) SELECT ox AS out_x, oy AS out_y, sample, 1 AS level FROM (SELECT unnest(range(8)) AS ox) JOIN half ON px = 2 + ((2 * ox + 1) * 20) // 16 JOIN (SELECT unnest(range(16)) AS oy) ON py = 5 + ((2 * oy + 1) * 40) // 32")
def raster_window_read(spark, sf_dir):
    """A window of 40 x 80 pixels as 8 x 16: the half-size overview serves it."""
    base = pixels(spark, sf_dir)
    half = base.groupBy(F.expr("px div 2").alias("px"), F.expr("py div 2").alias("py")).agg(F.min("sample").alias("sample"))
    level, out = rasters.read_window({0: base, 1: half}, (64, 400), {0: (64, 400), 1: (32, 200)}, (4, 10, 40, 80), 8, 16, ["sample"])
    return out.withColumn("level", F.lit(level))


@query("""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN s * 3 WHEN 1 THEN 100 - 2 * s ELSE NULL END + CASE WHEN p_partkey % 2 = 0 THEN (CASE p_partkey % 3 WHEN 0 THEN -0.75 WHEN 1 THEN -0.5 * s END) ELSE 0 END AS ox,
  CASE p_partkey % 3 WHEN 0 THEN 7 WHEN 1 THEN 200 + 3 * s END + CASE WHEN p_partkey % 2 = 0 THEN (CASE p_partkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.5 * s END) ELSE 0 END AS oy FROM (SELECT p_partkey, p_size::DOUBLE AS s FROM part)""")
def geotransform_from_tags(spark, sf_dir):
    """A matrix, a scale with a tie point, or neither; pixels are areas or points."""
    k, s = F.col("p_partkey") % 3, F.col("p_size").cast("double")
    d = lambda *v: F.array(*[x if not isinstance(x, (int, float)) else F.lit(float(x)) for x in v])
    matrix = F.when(k == 0, d(1, 0.5, 0, s * 3, 0.5, -1.5, 0, 7, 0, 0, 0, 0, 0, 0, 0, 1)).otherwise(F.array().cast("array<double>"))
    t = R.from_tags(matrix, F.when(k == 1, F.array(s, s)), F.when(k == 1, d(2, 3, 0, 100, 200, 0)), F.when(F.col("p_partkey") % 2 == 0, "Point").otherwise("Area"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), t.alias("t")).select("id", "t.ox", "t.oy")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey - p_size / 2::DOUBLE - 0.125::DOUBLE END AS ox, CASE WHEN p_partkey % 4 <> 0 THEN p_size::DOUBLE END AS a, CASE WHEN p_partkey % 4 <> 0 THEN -3::DOUBLE END AS e FROM part")
def worldfile_affine(spark, sf_dir):
    """Every fourth file has five numbers and is none."""
    p = table(spark, sf_dir, "part")
    text = F.concat_ws("\n", F.col("p_size").cast("string"), F.lit("0.5"), F.lit(" 0.25 "), F.lit("-3"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 4 != 0, "-41.5\r\n"))
    return p.select(F.col("p_partkey").alias("id"), R.from_world_file(text).alias("t")).select("id", "t.ox", "t.a", "t.e")


@query("SELECT p_partkey AS id, b::INT AS band, CASE WHEN p_size % 6 IN (0, 1) THEN (CASE WHEN b = 0 THEN 'Gray' ELSE 'Alpha' END) WHEN p_size % 6 = 2 THEN (CASE b WHEN 0 THEN 'Red' WHEN 1 THEN 'Green' WHEN 2 THEN 'Blue' WHEN 3 THEN 'Alpha' END) WHEN p_size % 6 = 3 AND b = 0 THEN 'Palette' ELSE 'Unknown' END AS color, CASE p_size % 6 WHEN 0 THEN 'WhiteIsZero' WHEN 1 THEN 'BlackIsZero' WHEN 2 THEN 'RGB' WHEN 3 THEN 'Palette' WHEN 5 THEN 'Separated' ELSE 'TIFF Photometric 4' END AS model FROM part, (SELECT unnest(range(4)) AS b)")
def geotiff_bands(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 6).alias("photometric"), F.lit(4).alias("samples"))
    return rasters.band_table(p, "photometric", "samples").select("id", "band", "color", R.color_model(F.col("photometric")).alias("model"))


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN -9999.5::DOUBLE END AS nodata FROM part")
def nodata_parse(spark, sf_dir):
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" \0\0"))).when(F.col("p_partkey") % 3 == 1, "-9999.5").otherwise("none")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), R.nodata(text).alias("nodata"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 4 < 3 THEN 'EPSG' END AS authority, CASE p_size % 4 WHEN 0 THEN '3857' WHEN 1 THEN '4326' WHEN 2 THEN '32633' END AS code FROM part")
def geokey_crs(spark, sf_dir):
    k = F.col("p_size") % 4
    projected = F.when(k == 0, 3857).when(k == 1, 32767).when(k == 2, 32633).otherwise(0)
    crs = R.geokey_crs(projected, F.when(k == 1, 4326).when(k == 2, 4326), F.lit("cite"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), crs.alias("c")).select("id", "c.authority", "c.code")


@query("SELECT p_partkey AS id, p_size % 4 = 0 AS valid FROM part")
def buffer_check(spark, sf_dir):
    """A buffer must have exactly width * height * bytes of a pixel."""
    pixels_ = F.repeat(F.lit("x"), F.col("p_size") * 3 * 4 + F.when(F.col("p_size") % 4 == 0, 0).otherwise(1)).cast("binary")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), R.buffer_valid(pixels_, F.col("p_size"), F.lit(3), F.lit("Rgba32")).alias("valid"))


@query("""WITH u AS (SELECT user_id AS key, max(event_id) AS last_use, (user_id % 50 + 1)::BIGINT AS bytes FROM events GROUP BY user_id), f AS (SELECT *, sum(bytes) OVER (ORDER BY last_use DESC ROWS UNBOUNDED PRECEDING) AS used FROM u WHERE bytes <= 400)
  SELECT key, last_use, bytes FROM f WHERE used <= 400""")
def lru_residency(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("user_id") % 50 + 1).cast("long").alias("bytes"))
    return viewport.lru_residency(log, 400)


@query("SELECT user_id AS viewport, max(event_id) AS seq, arg_max(event_type, event_id) AS request FROM events GROUP BY user_id")
def latest_request(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("viewport"), F.col("event_id").alias("seq"), F.col("event_type").alias("request"))
    return viewport.latest_request(log)
