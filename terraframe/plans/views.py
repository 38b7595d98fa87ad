"""Spatial views of the driver's tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of events: id, x, y, kind, and the point's envelope."""
    e = table(spark, sf_dir, "events")
    x = F.expr("(event_id * 37 % 3600) / 10D - 180D")
    y = F.expr("(event_id * 91 % 1700) / 10D - 85D")
    p = e.select(F.col("event_id").alias("id"), x.alias("x"), y.alias("y"), "event_type", "value", "props")
    return p.withColumns({"minx": F.col("x"), "miny": F.col("y"), "maxx": F.col("x"), "maxy": F.col("y")})


PLACES = "places AS (SELECT event_id AS id, (event_id * 37 % 3600) / 10::DOUBLE - 180::DOUBLE AS x, (event_id * 91 % 1700) / 10::DOUBLE - 85::DOUBLE AS y, event_type, value, props FROM events)"


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of routes, one per order line."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.expr("l_partkey / 8D").alias("x"), F.expr("l_suppkey / 4D").alias("y"))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders: id and coords, in order of line number and position."""
    v = vertices(spark, sf_dir).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "x", "y"))).alias("v"))
    coord = lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), F.lit(None).cast("double").alias("z"), F.lit(None).cast("double").alias("m"))
    return v.select("id", F.transform("v", coord).alias("coords"))


VERTICES = "vertices AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey / 8::DOUBLE AS x, l_suppkey / 4::DOUBLE AS y FROM lineitem)"


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of parts: id and envelope."""
    p = table(spark, sf_dir, "part")
    p = p.select(F.col("p_partkey").alias("id"), F.expr("(p_partkey % 180) / 2D - 90D").alias("minx"), F.expr("(p_partkey % 85) - 40D").alias("miny"), "p_size", "p_type", "p_brand", "p_name")
    return p.withColumn("maxx", F.expr("minx + p_size / 2D")).withColumn("maxy", F.expr("miny + p_size / 2D"))


PARCELS = """base AS (SELECT p_partkey AS id, (p_partkey % 180) / 2::DOUBLE - 90::DOUBLE AS minx, (p_partkey % 85) - 40::DOUBLE AS miny, p_size, p_type, p_brand, p_name FROM part),
parcels AS (SELECT *, minx + p_size / 2::DOUBLE AS maxx, miny + p_size / 2::DOUBLE AS maxy FROM base)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of samples from embeddings: py is the vector, px the position."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("py"), F.posexplode("embedding").alias("px", "v")).select("px", "py", F.expr("CAST(floor((CAST(v AS DOUBLE) + 1D) * 127.5D) AS INT)").alias("sample"))


PIXELS = """pixels AS (SELECT vec_id AS py, (i - 1)::INT AS px, floor((embedding[i]::DOUBLE + 1::DOUBLE) * 127.5::DOUBLE)::INT AS sample FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""
