import math

import pytest
from pyspark.sql import functions as F

from terraframe.functions import crs as C, envelope as E, geometry as G, probe as P, raster as R
from terraframe.operators import index, layers, rasters

NAN = float("nan")


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


def test_envelope_contains_and_touching_edges(spark):
    box = E.literal((0, 0, 10, 20))
    r = one(spark, a=E.contains(box, F.lit(5.0), F.lit(6.0)), b=E.contains(box, F.lit(11.0), F.lit(6.0)), c=E.contains(box, F.lit(10.0), F.lit(20.0)))
    assert (r.a, r.b, r.c) == (True, False, True)
    ten = E.literal((0, 0, 10, 10))
    r = one(spark, a=E.intersects(ten, E.literal((10, 4, 12, 6))), b=E.intersects(ten, E.literal((10.1, 4, 12, 6))))
    assert (r.a, r.b) == (True, False)


def test_nan_and_inverted_bounds_never_match(spark):
    ten = E.literal((0, 0, 10, 10))
    r = one(spark, a=E.is_valid(E.literal((NAN, 0, 1, 1))), b=E.intersects(ten, E.literal((0, 0, NAN, 1))), c=E.intersects(ten, E.literal((5, 0, 1, 1))), d=E.contains(ten, F.lit(NAN), F.lit(1.0)))
    assert not any(r)


def test_union_with_invalid_is_identity(spark):
    r = one(spark, u=E.union(E.literal((0, 0, 1, 1)), E.literal((5, 5, 1, 1))), v=E.union(E.literal((0, 0, 1, 1)), E.literal((-1, 2, 3, 4)))).asDict(True)
    assert tuple(r["u"].values()) == (0, 0, 1, 1) and tuple(r["v"].values()) == (-1, 0, 3, 4)


def test_bounds_of_empty_and_nan(spark):
    coords = "array<struct<x:double,y:double,z:double,m:double>>"
    r = spark.createDataFrame([([],), ([(1.0, 2.0, None, None), (-4.0, 9.0, None, None)],), ([(NAN, 1.0, None, None), (2.0, 3.0, None, None)],)], f"c {coords}").select(E.of_coords(F.col("c")).alias("b")).collect()
    assert r[0].b is None and tuple(r[1].b) == (-4, 2, 1, 9)
    assert math.isnan(r[2].b.minx) and r[2].b.miny == 1


def test_rings_and_positions(spark):
    ring = "array<struct<x:double,y:double,z:double,m:double>>"
    p = lambda x, y, z=None: (float(x), float(y), z, None)
    data = [([],), ([p(0, 0), p(1, 0), p(1, 1), p(0, 0)],), ([p(0, 0), p(1, 0), p(1, 1), p(0, 1)],), ([p(0, 0), p(1, 0), p(0, 0)],), ([p(0, 0, 1.0), p(1, 0, 1.0), p(1, 1, 1.0), p(0, 0, 2.0)],)]
    got = [r.v for r in spark.createDataFrame(data, f"r {ring}").select(G.ring_valid(F.col("r")).alias("v")).collect()]
    assert got == [True, True, False, False, False]
    got = [r.v for r in spark.createDataFrame([([1.0],), ([1.0, 2.0],), ([1.0, 2.0, 3.0],), ([1.0, 2.0, 3.0, 4.0],), ([1.0, NAN],), ([1.0, None],)], "p array<double>").select(G.position_valid(F.col("p")).alias("v")).collect()]
    assert got == [False, True, True, False, False, False]


def test_wkt(spark):
    one_ = 'GEOGCS["WGS 84",AUTHORITY["EPSG","4326"]]'
    two = 'PROJCRS["M",BASEGEOGCRS["W",ID["EPSG",4326]],ID["EPSG",3857]]'
    local = 'LOCAL_CS["Site"]'
    got = spark.createDataFrame([(one_,), (two,), (local,)], "w string").select(C.parse_wkt(F.col("w")).alias("c"), C.epsg(C.make(None, None, F.col("w"), None)).alias("e")).collect()
    assert [r.e for r in got] == [4326, 3857, None]
    assert got[2].c.authority is None and got[2].c.name == "Site" and got[0].c.name == "WGS 84"


def test_mercator_literals_and_domain(spark):
    x, y = C.to_mercator(F.lit(1.0), F.lit(0.0))
    sx, sy = C.to_mercator(F.lit(0.0), F.lit(1.0), C.COMPLIANT)
    r = one(spark, x=x, y=y, sx=sx, nan=C.to_mercator(F.lit(1.0), F.lit(NAN))[1])
    assert 111319.4907 < r.x < 111319.4909 and abs(r.y) < 1e-9 and r.sx == r.x and math.isnan(r.nan)
    lon, lat = C.from_mercator(x, y)
    r = one(spark, lon=lon, lat=lat)
    assert abs(r.lon - 1) < 1e-9 and abs(r.lat) < 1e-9
    with pytest.raises(Exception, match="domain"):
        one(spark, y=C.to_mercator(F.lit(0.0), F.col("id") + 90.0)[1])
    with pytest.raises(ValueError):
        C.transform_coords(F.array(), 32651, 3857)


def test_only_equal_or_known_pairs_transform(spark):
    a, b, odd = C.from_epsg(F.lit(4326)), C.from_epsg(F.lit(3857)), C.make(F.lit("EPSG"), F.lit("4326"), None, F.lit("other"))
    r = one(spark, ab=C.can_transform(a, b), ba=C.can_transform(b, a), aa=C.can_transform(a, a), ao=C.can_transform(a, odd), un=C.is_unknown(C.make(None, None, None, F.lit("only a name"))))
    assert (r.ab, r.ba, r.aa, r.ao, r.un) == (True, True, True, False, True)


def test_affine(spark):
    t = R.affine(*[F.lit(v) for v in (100.0, 2.0, 0.25, 200.0, -0.5, -3.0)])
    x, y = R.pixel_to_world(t, F.lit(12.5), F.lit(8.25))
    r = one(spark, p=R.world_to_pixel(t, x, y), flat=R.world_to_pixel(R.affine(*[F.lit(v) for v in (0.0, 1.0, 2.0, 0.0, 2.0, 4.0)]), F.lit(1.0), F.lit(1.0)))
    assert abs(r.p.col - 12.5) < 1e-10 and abs(r.p.row - 8.25) < 1e-10 and r.flat is None
    b = one(spark, b=R.bounds(R.affine(*[F.lit(v) for v in (0.0, 2.0, 1.0, 10.0, 0.5, -2.0)]), F.lit(10.0), F.lit(5.0))).b
    assert tuple(b) == (0, 0, 25, 15)


def test_overview_choice(spark):
    levels = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(float(d)).alias("decx"), F.lit(float(d)).alias("decy")) for i, d in ((1, 2), (2, 4), (3, 8))])
    pick = lambda n: R.select_overview(F.lit(1000), F.lit(1000), F.lit(n), F.lit(n), levels)
    r = one(spark, a=pick(220), b=pick(1000), c=pick(10))
    assert (r.a, r.b, r.c) == (2, 0, 3)


def test_windows(spark):
    clip = lambda x, y, w, h: R.clip(R.window(*[F.lit(v) for v in (x, y, w, h)]), F.lit(10), F.lit(10))
    r = one(spark, a=clip(8, 8, 5, 1), b=clip(-1, 0, 5, 5), c=clip(10, 0, 1, 1))
    assert tuple(r.a) == (8, 8, 2, 1) and r.b is None and r.c is None
    with pytest.raises(ValueError):
        rasters.read_window({}, (10, 10), {}, (-1, 0, 5, 5), 2, 2, [])


@pytest.mark.parametrize("n,out", [(64, 120), (200, 24), (7, 7), (3, 10), (10, 3), (1, 5)])
def test_resample_is_nearest(spark, n, out):
    line = spark.range(n).select(F.col("id").cast("int").alias("px"), F.lit(0).alias("py"), F.col("id").alias("v"))
    got = {r.out_x: r.v for r in rasters.resample(line, (0, 0, n, 1), out, 1, ["v"]).collect()}
    assert got == {i: min(n - 1, (2 * i + 1) * n // (2 * out)) for i in range(out)}


def test_probe(spark):
    got = spark.createDataFrame([("a.GeoJSON",), ("b.json",), ("c.shx",), ("dir.tif/none",)], "p string").select(P.probe(F.col("p")).alias("p")).collect()
    assert [(r.p.format, r.p.confidence) for r in got] == [("geojson", 100), ("geojson", 50), (None, 0), (None, 0)]
    with pytest.raises(ValueError):
        P.resolve("x.dbf")


def test_index(spark):
    boxes = [(1, 0.0, 0.0, 2.0, 2.0), (2, 5.0, 5.0, 8.0, 8.0), (3, 20.0, 20.0, 30.0, 30.0), (4, -9.0, -9.0, -8.0, -8.0)]
    df = spark.createDataFrame(boxes, "v int, minx double, miny double, maxx double, maxy double")
    assert sorted(r.v for r in index.query(index.build(df, "v"), (1, 1, 6, 6)).collect()) == [1, 2]
    assert index.query(index.build(df.limit(0), "v"), (1, 1, 6, 6)).count() == 0
    with pytest.raises(ValueError):
        index.query(df, (6, 1, 1, 6))
    with pytest.raises(Exception, match="invalid bounds"):
        index.build(spark.createDataFrame([(1, 2.0, 0.0, 1.0, 1.0)], df.schema), "v").collect()


def test_spatial_join_equals_all_pairs(spark):
    import random

    rnd = random.Random(3)
    box = lambda i: (i, x := rnd.uniform(-20, 20), y := rnd.uniform(-20, 20), x + rnd.choice([0, 1, 9]), y + rnd.choice([0, 2, 7]))
    a, b = [box(i) for i in range(60)], [box(i) for i in range(50)]
    schema = "id int, minx double, miny double, maxx double, maxy double"
    got = sorted((r.l_id, r.r_id) for r in index.spatial_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 3.0).collect())
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2])
    assert got == want


def test_extent_reaches_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], "v int, minx double, miny double, maxx double, maxy double")
    df.write.parquet(str(tmp_path / "t"))
    plan = layers.extent_filter(spark.read.parquet(str(tmp_path / "t")), (0, 0, 5, 5))._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(minx,5.0)" in plan and "GreaterThanOrEqual(maxx,0.0)" in plan
