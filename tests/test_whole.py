"""Queries over whole tables, where the tables are larger or other than the smallest ones."""

import duckdb
import pytest

import terraframe.plans  # noqa: F401  fills the registry
from terraframe.plans import registry

from test_oracles import rows


def equal_to_sql(spark, name, folder, tables):
    db = duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    found = db.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, found.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert got == want
    return got


@pytest.fixture
def grid(tmp_path):
    """A table of 131 vectors, which is neither 100 nor 500."""
    duckdb.execute(f"COPY (SELECT i AS vec_id, [((i * 7 + k * 3) % 200 / 100.0 - 1)::FLOAT FOR k IN range(64)] AS embedding, 0 AS label FROM range(131) t(i)) TO '{tmp_path}/embeddings.parquet'")
    return tmp_path


@pytest.mark.parametrize("rows_a_file", [1024, 50])
def test_world_image_holds_all_rows(spark, grid, monkeypatch, rows_a_file):
    from terraframe.plans import source_queries

    monkeypatch.setattr(source_queries, "IMAGE_ROWS", rows_a_file)
    assert len(equal_to_sql(spark, "worldimage_read", grid, ["embeddings"])) == 131 * 64


def test_geotiff_metadata_of_any_height(spark, grid):
    (row,) = equal_to_sql(spark, "geotiff_metadata", grid, ["embeddings"])
    assert "131" in row and "-1110.0" in row  # height and lower edge


def test_raster_samples_of_all_rows(spark, grid):
    assert len(equal_to_sql(spark, "geotiff_samples", grid, ["embeddings"])) == 131 * 64


def test_all_declared_boxes_are_read(spark, tmp_path):
    part = spark.range(50).selectExpr("id AS p_partkey", "concat('n', id) AS p_name", "'b' AS p_brand", "'t' AS p_type", "CAST(id % 50 + 1 AS INT) AS p_size")
    part.repartition(3).write.parquet(str(tmp_path / "part.parquet"))
    duckdb.execute(f"COPY (SELECT * FROM '{tmp_path}/part.parquet/*.parquet') TO '{tmp_path}/one.parquet'")
    (tmp_path / "sf").mkdir()
    (tmp_path / "one.parquet").rename(tmp_path / "sf" / "part.parquet")
    assert len(equal_to_sql(spark, "geojson_bbox", tmp_path / "sf", ["part"])) == 50
    assert len(equal_to_sql(spark, "geojson_kinds", tmp_path / "sf", ["part"])) == 50


def test_join_of_envelopes_of_any_size(spark):
    """From points to boxes over everything: no envelope is posted to more than a few cells."""
    import random

    from terraframe.operators import index

    rnd = random.Random(4)

    def boxes(n, prefix):
        out = []
        for i in range(n):
            side = rnd.choice([0, 0, 0.5, 3, 40, 1000, 1e6])
            x, y = rnd.uniform(-500, 500), rnd.uniform(-500, 500)
            out.append((i, x, y, x + side * rnd.random(), y + side))
        return out

    schema = "id int, minx double, miny double, maxx double, maxy double"
    a, b = boxes(150, "l"), boxes(130, "r") + [(999, 5.0, 5.0, 1.0, 1.0), (998, float("nan"), 0.0, 1.0, 1.0)]
    got = sorted((r.l_id, r.r_id) for r in index.spatial_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 1.0).collect())
    want = sorted((i, j) for i, *p in a for j, *q in b if q[0] <= q[2] and p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3])
    assert got == want and len(got) > 100


def test_join_of_whole_tables_equals_brute_force(spark, tmp_path):
    events = spark.range(3000).selectExpr("id AS event_id", "id AS user_id", "'e' AS event_type", "1D AS value", "'{}' AS props")
    part = spark.range(200).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "CAST(id % 50 + 1 AS INT) AS p_size")
    events.write.parquet(str(tmp_path / "events.parquet"))
    part.write.parquet(str(tmp_path / "part.parquet"))
    points = [(i, (i * 37 % 3600) / 10 - 180, (i * 91 % 1700) / 10 - 85) for i in range(3000)]
    boxes = [(i, (i % 180) / 2 - 90, i % 85 - 40, (i % 50 + 1) / 2) for i in range(200)]
    want = sorted((a, b) for a, x, y in points for b, left, low, side in boxes if left <= x <= left + side and low <= y <= low + side)
    sizes = {b % 50 + 1 for _, b in want}
    assert min(sizes) < 6 and max(sizes) > 40 and any(6 <= s <= 40 for s in sizes)
    got = sorted((r.l_id, r.r_id) for r in registry.QUERIES["spatial_join_whole"](spark, str(tmp_path)).collect())
    assert got == want


def test_rows_of_equal_envelopes_are_joined_as_one(spark, monkeypatch):
    """The join compares different envelopes; an envelope of very many rows is listed in parts, and every pair of rows is there once."""
    from terraframe.operators import index

    monkeypatch.setattr(index, "CLASS", 50)
    a = spark.range(2000).selectExpr("id AS k", "'a' AS s", "IF(id < 1500, 0D, id % 7) AS minx", "0D AS miny", "IF(id < 1500, 0D, id % 7) AS maxx", "1D AS maxy")
    b = spark.range(300).selectExpr("IF(id % 2 = 0, 0D, 3D) AS minx", "id AS k", "0D AS miny", "IF(id % 2 = 0, 2D, 3D) AS maxx", "0D AS maxy")
    df = index.spatial_join(a, b, 1.0)
    assert df.columns == ["l_k", "l_s", "l_minx", "l_miny", "l_maxx", "l_maxy", "r_minx", "r_k", "r_miny", "r_maxx", "r_maxy"]
    got = [(r.l_k, r.r_k) for r in df.select("l_k", "r_k").collect()]
    at = lambda i: 0 if i < 1500 else i % 7
    want = {(i, j) for i in range(2000) for j in range(300) if (at(i) <= 2 if j % 2 == 0 else at(i) == 3)}
    assert len(got) == len(want) and set(got) == want
    listed = index._classes(a, "l_").selectExpr("size(l_rows) AS n").collect()
    assert 20 < len(listed) < 200 and max(r.n for r in listed) < 200 and sum(r.n for r in listed) == 2000
    assert df.select("l_minx", "l_s", "r_maxx").distinct().count() == 4
    sides = a.select("minx", "miny", "maxx", "maxy")
    assert index.spatial_join(sides, sides.limit(3), 1.0).count() == 3 * sum(at(i) == 0 for i in range(2000))


def test_rows_of_crowded_envelopes_are_yielded_pair_by_pair(spark):
    """Who takes the first row of a join waits for one pair of lists, not for all rows that an envelope gives."""
    from terraframe.operators import index

    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    points = spark.range(200).selectExpr("id AS k", "1D AS minx", "1D AS miny", "1D AS maxx", "1D AS maxy")
    boxes = spark.range(900).selectExpr("id AS k", "0D AS minx", "0D AS miny", "2 + id % 300 / 1000D AS maxx", "2D AS maxy")
    confs = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # sort-merge joins, as larger tables get
    before = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        for left, right in ((points, boxes), (boxes, points)):
            df = index.spatial_join(left, right, 5.0)
            plan = df._jdf.queryExecution().executedPlan()
            assert len(plan.execute().take(1)) == 1
            made = [n.metrics().apply("numOutputRows").value() for n in nodes(plan) if n.nodeName() == "Generate" and "_row#" in n.simpleString(50)]
            assert len(made) == 4 and 0 < max(made) <= 1000
            assert df.distinct().count() == 200 * 900
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_posted_envelopes_do_not_go_through_the_driver(spark):
    """Spark takes the posted lists for far smaller than they are; the join broadcasts neither side, by hint or by adaptive execution."""
    from pyspark.sql import functions as F
    from terraframe.operators import index

    def nodes(plan):
        yield plan
        inner = [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.plan()] if plan.nodeName().endswith("QueryStage") else []
        for p in [*inner, *[plan.children().apply(i) for i in range(plan.children().size())]]:
            yield from nodes(p)

    points = spark.range(2000).selectExpr("id AS k", "id * 7 % 90D AS minx", "id % 40D AS miny", "id * 7 % 90D AS maxx", "id % 40D AS maxy")
    boxes = spark.range(4000).selectExpr("id AS k", "id % 80D AS minx", "id % 31D AS miny", "id % 80D + 17 AS maxx", "id % 31D + 17 + id DIV 2480 AS maxy")
    key, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"
    before = {k: spark.conf.get(k) for k in (key, adaptive)}
    limit = 1 << 20
    want = points.alias("a").join(boxes.alias("b"), F.expr("a.minx <= b.maxx AND a.maxx >= b.minx AND a.miny <= b.maxy AND a.maxy >= b.miny")).count()
    spark.conf.set(key, str(limit))
    spark.conf.set(adaptive, "true")
    try:
        for left, right in ((points, boxes), (boxes, points)):
            df = index.spatial_join(left, right, 5.0)
            plan = df._jdf.queryExecution().executedPlan()
            assert len(plan.executeCollect()) == want
            found = list(nodes(plan))
            sent = [n.metrics().apply("dataSize").value() for n in found if n.nodeName() == "BroadcastExchange"]
            joins = [n.nodeName() for n in found if "Join" in n.nodeName() and "_at#" in n.simpleString(50)]
            assert max(sent, default=0) <= limit
            assert joins and not any("Broadcast" in n for n in joins)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
