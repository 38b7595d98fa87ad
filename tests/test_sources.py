import contextlib
import datetime
import decimal
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraframe.operators import flatten
from terraframe.sources import files, geojson, geometry as G, geopackage, geotiff, readers, shapefile, worldimage


def point(x, y, z=None, m=None):
    return G.single("Point", [[[(float(x), float(y), z, m)]]])


def feature(id, kind, coordinates, properties=None, **more):
    geometry = {"type": kind, "geometries" if kind == "GeometryCollection" else "coordinates": coordinates}
    return {"type": "Feature", "id": id, "geometry": geometry, "properties": properties or {}} | more


BUOY = {"label": "north buoy", "lit": False, "depth": 18, "draught": 0.25, "owner": None, "checks": [2, "b", None], "mast": {"height": 4}}
SQUARE = [[40, 40], [44, 40], [44, 44], [40, 44], [40, 40]]
HARBOUR = {
    "type": "FeatureCollection",
    "bbox": [-5, -5, 70, 60],
    "features": [
        feature("pier", "LineString", [[41, 39], [41, 46], [60, 46]]),
        feature(7, "Point", [42, 43, -2.5], BUOY, bbox=[42, 43, 42, 43]),
        feature("quay", "Polygon", [SQUARE]),
        feature("marks", "MultiPoint", [[43, 41], [43.5, 42], [69, 59]]),
        {"type": "Feature", "id": "lost", "geometry": None, "properties": None},
        feature("chart", "GeometryCollection", [{"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 1]}]}, {"type": "Polygon", "coordinates": [SQUARE]}]),
        feature("ferries", "MultiLineString", [[[0, 0], [5, 5]], [[-5, 0], [0, -5]]]),
        feature("isles", "MultiPolygon", [[SQUARE], [[[50, 50], [51, 50], [51, 51], [50, 50]]]]),
    ],
}


@pytest.fixture
def collection(tmp_path):
    path = tmp_path / "harbour.geojson"
    path.write_text(json.dumps(HARBOUR))
    return str(path)


def test_geojson_features_and_metadata(spark, collection):
    f = {r.feature_id: r for r in readers.read_features(spark, collection).collect()}
    assert list(f) == ["pier", "7", "quay", "marks", "lost", "chart", "ferries", "isles"] and f["lost"].geometry is None and f["lost"].minx is None
    assert f["7"].geometry.members[0].parts[0][0][0].z == -2.5 and f["7"].declared_bounds.miny == 43
    assert json.loads(f["7"].attributes) == BUOY and json.loads(f["lost"].attributes) == {}
    assert [tuple(m.path) for m in f["chart"].geometry.members] == [(0, 0), (1,)]
    m = readers.vector_layers(spark, collection).first()
    assert m.feature_count == 8 and m.geometry_type is None and tuple(m.bounds) == (-5, -5, 70, 60) and m.crs.code is None and m.layer == "harbour"
    v = readers.with_variant(readers.read_features(spark, collection)).filter("feature_id = '7'").select(F.schema_of_variant("attributes").alias("s")).first().s
    assert "draught: DECIMAL(2,2)" in v and "depth: BIGINT" in v


def test_geojson_extent_and_flatten(spark, collection):
    view = (42.5, 40.5, 44, 45)
    f = readers.read_features(spark, collection, extent=view)
    assert [r.feature_id for r in f.collect()] == ["pier", "quay", "marks", "chart", "isles"]
    got = sorted((r.feature_id, r.kind) for r in flatten.render_frame(f.select("feature_id", "geometry"), view).collect())
    # a member is drawn with all its parts if its bounds meet the view
    assert got == [("chart", "Polygon"), *[("isles", "Polygon")] * 2, *[("marks", "Point")] * 3, ("pier", "Polyline"), ("quay", "Polygon")]
    with pytest.raises(ValueError):
        readers.read_features(spark, collection, extent=(5, 0, 1, 1))
    with pytest.raises(Exception, match="no layer"):
        readers.read_features(spark, collection, layer="Harbour").collect()


@pytest.mark.parametrize("split", [181, 1500])
def test_large_geojson_is_dealt_out(spark, tmp_path, monkeypatch, split):
    """Cut into chunks at any byte, also within strings, escapes and letters of several bytes."""
    tricky = {"note": 'a "quoted" ] } , { [ \\ back\\\\ slash" é日本 "features": [', "features": [{"a": [1, {"b": "}"}]}], "n\\": "\\\\\""}
    features = [feature(i, "Point", [i % 7, i // 7], tricky | {"i": i}) if i % 3 else {"type": "Feature", "id": i, "bbox": [0, 0, i, i], "geometry": None, "properties": None} for i in range(25)]
    text = json.dumps({"before": {"features": [1, 2, {"x": [3]}]}, "crs": {"type": "name", "properties": {"name": "EPSG:3857"}}, "type": "FeatureCollection", "features": features, "bbox": [0, 0, 50, 50], "after": [[1], [{"type": "Feature"}]]}, indent=1, ensure_ascii=split > 1000)
    path = str(tmp_path / "big.geojson")
    (tmp_path / "big.geojson").write_text(text)
    plain = readers.read_features(spark, path)
    want, layer = plain.orderBy("seq").collect(), readers.vector_layers(spark, path).collect()
    monkeypatch.setattr(readers, "SPLIT_BYTES", split)
    dealt = readers.read_features(spark, path)
    assert dealt.rdd.getNumPartitions() > (8 if split < 1000 else 2) and plain.rdd.getNumPartitions() == 1
    assert dealt.orderBy("seq").collect() == want and readers.vector_layers(spark, path).collect() == layer
    assert [r.feature_id for r in readers.read_features(spark, path, extent=(2, 2, 3, 3)).collect()] == [r.feature_id for r in want if r.feature_id in {str(x["id"]) for x in features if x["geometry"] is None and x["id"] >= 2 or x["geometry"] and 2 <= x["id"] % 7 <= 3 and 2 <= x["id"] // 7 <= 3}]


def test_faults_of_a_large_geojson_are_found(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "SPLIT_BYTES", 60)
    for n, text in enumerate(['{"type":"FeatureCollection","features":[%s %s]}', '{"type":"FeatureCollection","features":[%s,,%s]}', '{"type":"FeatureCollection","features":[%s,7,%s]}', '{"type":"FeatureCollection","features":[%s,%s']):
        one = json.dumps(feature(1, "Point", [1, 2]))
        (tmp_path / f"{n}.geojson").write_text(text % (one, one))
        with pytest.raises(Exception, match=f"{n}.geojson"):
            readers.read_features(spark, str(tmp_path / f"{n}.geojson")).collect()


def test_declared_box_of_a_feature_without_geometry_passes(spark, tmp_path):
    path = tmp_path / "d.geojson"
    path.write_text('{"type":"FeatureCollection","features":[{"type":"Feature","id":1.50,"bbox":[0,0,1,1],"geometry":null,"properties":{}},{"type":"Feature","bbox":[0,0,1,1],"geometry":{"type":"Point","coordinates":[9,9]},"properties":{}}]}')
    assert [r.feature_id for r in readers.read_features(spark, str(path), extent=(0, 0, 2, 2)).collect()] == ["1.50"]


@pytest.mark.parametrize(
    "text,said",
    [
        ('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1]]]},"properties":{}}', "not closed"),
        ('{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2,3,4]},"properties":{}}', "silently discarded"),
        ('{"type":"Feature","geometry":null}', "properties"),
        ('{"type":"Feature","id":null,"geometry":null,"properties":{}}', "id"),
        ('{"type":"Feature","bbox":[3,0,1,1],"geometry":null,"properties":{}}', "bbox"),
        ('{"type":"Feature","geometry":{"type":"LineString","coordinates":[[1,1]]},"properties":{}}', "line"),
        ('{"type":"Feature","geometry":null,"properties":{"a":1,"a":2}}', "repeats"),
        ('{"type":"Circle"}', "Circle"),
        ("[1]", "root"),
    ],
)
def test_malformed_geojson(text, said):
    with pytest.raises(G.Malformed, match=said):
        geojson.features(geojson.parse(text, "f"))


def test_invalid_json_names_the_path():
    with pytest.raises(G.Malformed, match="here.geojson is not valid JSON"):
        geojson.parse('{"type":', "here.geojson")
    with pytest.raises(G.Malformed, match="deeper"):
        geojson.parse("[" * 129 + "]" * 129, "x")


def test_geojson_crs_and_bare_geometry():
    root = geojson.parse('{"type":"LineString","coordinates":[[0,0],[1,1]],"crs":{"type":"name","properties":{"name":"EPSG:25832"}}}', "f")
    assert geojson.crs(root)["code"] == "25832" and len(geojson.features(root)) == 1
    assert geojson.crs({"crs": None})["authority"] is None


FIELDS = [("NAME", "C", 20, 0), ("VALUE", "N", 12, 2), ("ACTIVE", "L", 1, 0), ("WHEN", "D", 8, 0), ("N4", "I", 4, 0), ("MONEY", "Y", 8, 0)]


def write_shapefile(folder, shapes, rows, fields=FIELDS, codec="utf-8", cpg="UTF-8", prj=None):
    shp, shx = shapefile.encode_shapes(shapes)
    (folder / "s.shp").write_bytes(shp)
    (folder / "s.shx").write_bytes(shx)
    (folder / "s.dbf").write_bytes(shapefile.encode_table(fields, rows, codec))
    if cpg is not None:
        (folder / "s.cpg").write_text(cpg)
    if prj is not None:
        (folder / "s.prj").write_text(prj)
    return str(folder / "s.shp")


def row(name, value, **more):
    return {"NAME": name, "VALUE": decimal.Decimal(str(value)), "ACTIVE": False, "WHEN": datetime.date(1999, 2, 28), "N4": 7, "MONEY": "1.5"} | more


def test_shapefile_points(spark, tmp_path):
    path = write_shapefile(tmp_path, [point(-3, 8, 0.5, 9.0), None, point(60, -70, -1.0, 2.0)], [row("Œuvre ß", "0.75"), row("none", 2), row("far", 1)], prj='PROJCS["Grid",GEOGCS["G",AUTHORITY["EPSG","4258"]],AUTHORITY["EPSG","25832"]]')
    f = readers.read_features(spark, path).collect()
    assert len(f) == 3 and f[1].geometry is None
    p = f[0].geometry.members[0].parts[0][0][0]
    assert (p.x, p.y, p.z, p.m) == (-3, 8, 0.5, 9) and f[0].declared_bounds is None
    a = json.loads(f[0].attributes)
    assert a == {"NAME": "Œuvre ß", "VALUE": 0.75, "ACTIVE": False, "WHEN": "1999-02-28", "N4": 7, "MONEY": 1.5}
    assert [r.feature_id for r in readers.read_features(spark, path, extent=(50, -80, 70, 0)).collect()] == ["3"]
    m = readers.vector_layers(spark, path).first()
    assert tuple(m.bounds) == (-3, -70, 60, 8) and m.crs.code == "25832" and m.crs.name == "Grid" and m.geometry_type == "Point" and m.feature_count == 3


def test_a_declared_box_that_contradicts_its_line(spark, tmp_path):
    """Both must meet the extent: a wrong box hides a record, and none brings in a line that lies elsewhere."""
    line = G.single("LineString", [[[(0.0, 0.0, None, None), (2.0, 2.0, None, None)]]])
    path = write_shapefile(tmp_path, [line, line], [row("moved", 1), row("right", 1)])
    data = bytearray((tmp_path / "s.shp").read_bytes())
    struct.pack_into("<4d", data, 100 + 8 + 4, 50, 50, 60, 60)
    (tmp_path / "s.shp").write_bytes(bytes(data))
    read = lambda *extent: [r.feature_id for r in readers.read_features(spark, path, extent=extent).collect()]
    assert read(0, 0, 3, 3) == ["2"] and read(49, 49, 70, 70) == [] and read(0, 0, 70, 70) == ["1", "2"]


def test_shapefile_lines_deleted_rows_and_code_pages(spark, tmp_path):
    two = G.single("MultiLineString", [[[(3.0, 1.0, 7.0, 0.5), (4.0, 2.0, 8.0, 1.5), (4.0, 9.0, 8.0, 2.5)]], [[(20.0, 5.0, 0.0, 3.5), (25.0, 5.0, 1.0, None)]]])
    alone = G.single("LineString", [[[(0.0, 0.0, 1.0, 1.0), (5.0, 5.0, 1.0, 1.0)]]])
    path = write_shapefile(tmp_path, [two, alone, alone], [{"NAME": "façade"}, None, {"NAME": "x"}], [("NAME", "C", 10, 0)], "cp1252", "1252")
    f = readers.read_features(spark, path).collect()
    assert [r.feature_id for r in f] == ["1", "3"] and f[0].geometry.type == "MultiLineString" and f[1].geometry.type == "LineString"
    assert json.loads(f[0].attributes)["NAME"] == "façade" and f[0].geometry.members[0].parts[1][0][1].m is None
    m = readers.vector_layers(spark, path).first()
    assert m.feature_count == 3 and m.geometry_type == "MultiLineString" and m.crs.wkt is None
    assert [(r.record_no, r.deleted, r.NAME) for r in readers.read_dbf(spark, str(tmp_path / "s.dbf")).collect()] == [(0, False, "façade"), (1, True, None), (2, False, "x")]


def test_shapefile_errors(spark, tmp_path):
    path = write_shapefile(tmp_path, [point(1, 2)], [row("a", 1)], prj=" ")
    with pytest.raises(Exception, match="is empty"):
        readers.vector_layers(spark, path).collect()
    (tmp_path / "s.shx").unlink()
    with pytest.raises(Exception, match="SHX index"):
        readers.read_features(spark, path).collect()
    with pytest.raises(G.Malformed, match="truncated"):
        G.shape(struct.pack("<i4di", 8, 0, 0, 1, 1, 5))
    with pytest.raises(G.Unsupported):
        G.shape(struct.pack("<i4d", 31, 0, 0, 1, 1))
    with pytest.raises(G.Malformed, match="CPG"):
        shapefile.encoding("", 0)
    assert [shapefile.encoding(None, b) for b in (3, 0x7A, 9)] == ["cp1252", "cp936", "latin-1"] and shapefile.encoding("65001", 0) == "utf-8"


def test_polygon_rings_and_measures():
    ring = [(0.0, 0.0, None, 1.0), (1.0, 0.0, None, None), (1.0, 1.0, None, 2.0), (0.0, 0.0, None, 1.0)]
    kind, content = shapefile._content(G.single("Polygon", [[ring, ring]]))
    back = G.shape(content)
    assert kind == 25 and back["type"] == "Polygon" and len(back["members"][0]["parts"][0]) == 2 and back["members"][0]["parts"][0][0][1][3] is None
    _, content = shapefile._content(G.single("MultiPoint", [[[(1.0, 2.0, None, None)]], [[(3.0, 4.0, None, None)]]]))
    assert len(G.shape(content)["members"][0]["parts"]) == 2


def write_gpkg(tmp_path, **more):
    path = tmp_path / "p.gpkg"
    wells = {"name": "wells", "kind": "POINT", "srs": 4326, "columns": [("owner", "TEXT"), ("flow", "REAL")], "rows": [(11, point(-20, 15, 7.0, 8.0), ["Åse", 0.25]), (12, None, ["dry", -1.0]), (15, point(80, 80, 0.0, 0.0), ["away", 3.0])], "index": True}
    line = G.single("LineString", [[[(0.0, 0.0, 1.0, 2.0), (1.0, 1.0, 1.0, 2.0)]]])
    pipes = {"name": "pipes", "kind": "LINESTRING", "srs": 4326, "columns": [("bore", "TEXT")], "rows": [(1, line, ["wide"])], "index": False}
    path.write_bytes(geopackage.encode([wells | more, pipes]))
    return str(path)


def test_geopackage(spark, tmp_path):
    path = write_gpkg(tmp_path)
    f = {r.feature_id: r for r in readers.read_features(spark, path, layer="wells").collect()}
    assert sorted(f) == ["11", "12", "15"] and f["12"].geometry is None
    p = f["11"].geometry.members[0].parts[0][0][0]
    assert (p.x, p.y, p.z, p.m) == (-20, 15, 7, 8)
    assert json.loads(f["11"].attributes) == {"fid": 11, "owner": "Åse", "flow": 0.25}
    assert [r.feature_id for r in readers.read_features(spark, path, layer="wells", extent=(-30, 0, 0, 20)).collect()] == ["11"]
    assert [r.feature_id for r in readers.read_features(spark, path, layer="pipes", extent=(0, 0, 10, 10)).collect()] == ["1"]
    m = readers.vector_layers(spark, path).orderBy("layer").collect()
    assert [(r.layer, r.feature_count, r.geometry_type, r.crs.code) for r in m] == [("pipes", 1, "LineString", "4326"), ("wells", 3, "Point", "4326")]


def test_the_index_of_a_geopackage_is_trusted(spark, tmp_path):
    import sqlite3

    path = write_gpkg(tmp_path)
    db = sqlite3.connect(path)
    db.execute('UPDATE "rtree_wells_geom" SET minx = -5, maxx = -5, miny = 5, maxy = 5 WHERE id = 15')
    db.commit()
    db.close()
    assert sorted(r.feature_id for r in readers.read_features(spark, path, layer="wells", extent=(-30, 0, 0, 20)).collect()) == ["11", "15"]


def test_geopackage_errors(tmp_path):
    import sqlite3

    path = str(tmp_path / "x.gpkg")
    sqlite3.connect(path).execute("CREATE TABLE t (a)")
    with pytest.raises(G.Malformed, match="application_id"):
        geopackage.Package(path)
    for blob, error in ((b"XX" + b"\0" * 20, G.Malformed), (b"GP\1\1" + b"\0" * 20, G.Unsupported), (b"GP\0\xc1" + b"\0" * 20, G.Malformed), (b"GP\0\x21" + b"\0" * 20, G.Unsupported), (b"GP\0\x01", G.Malformed), (b"GP\0\x0b" + b"\0" * 100, G.Malformed)):
        with pytest.raises(error):
            G.gpkg_blob(blob)


def test_wkb_kinds():
    line = struct.pack("<BII4d", 1, 2, 2, 0, 0, 1, 1)
    collection = struct.pack("<BII", 1, 7, 2) + line + struct.pack("<BI2d", 1, 1, float("nan"), float("nan"))
    g = G.wkb(collection + b"tail")
    assert g["type"] == "GeometryCollection" and [m["type"] for m in g["members"]] == ["LineString"]
    ewkb = struct.pack("<BII3d", 1, 1 | 0x80000000 | 0x20000000, 4326, 1, 2, 3)
    assert next(G.positions(G.wkb(ewkb))) == (1, 2, 3, None)
    big = struct.pack(">BI4d", 0, 3001, 1, 2, 3, 4)
    assert next(G.positions(G.wkb(big))) == (1, 2, 3, 4)
    assert G.wkb(struct.pack("<BI2d", 1, 1, float("nan"), float("nan"))) is None
    with pytest.raises(G.Malformed):
        G.wkb(struct.pack("<BII", 1, 4, 1) + line)
    with pytest.raises(G.Malformed, match="truncated"):
        G.wkb(line[:-3])
    for g in (point(1, 2), G.single("MultiPolygon", [[[(0.0, 0.0, None, None)] * 4], [[(1.0, 1.0, None, None)] * 4]]), G.single("MultiPoint", [[[(1.0, 2.0, None, None)]]])):
        assert G.wkb(G.to_wkb(g)) == g
    empty = G.gpkg_blob(b"GP\0\x11" + struct.pack("<i", 1) + struct.pack("<BII", 1, 2, 0))
    assert empty[0]["type"] == "LineString" and G.bounds(empty[0]) is None and empty[3]


def ramp(w, h, f):
    a = np.zeros((h, w, 3), np.uint8)
    for y in range(h):
        for x in range(w):
            a[y, x] = f(x, y)
    return a


KEYS = {geotiff.SCALE: (12, [2.5, 5.0, 0.0]), geotiff.TIEPOINT: (12, [0.0, 0.0, 0.0, 1000.0, 400.0, 0.0]), geotiff.NODATA: (2, "7")}


def plaid(x, y):
    return 3 * x % 251, 5 * y % 251, (x ^ y) % 251


def test_geotiff_tiles_and_overview(spark, tmp_path):
    a = ramp(70, 50, plaid)
    tags = KEYS | {geotiff.GEOKEYS: (3, [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 25832])}
    path = str(tmp_path / "t.tif")
    (tmp_path / "t.tif").write_bytes(geotiff.encode([(a, 2), (a[::2, ::2], 2)], tile=32, tags=tags))
    m = readers.raster_layers(spark, path).first()
    assert tuple(m.bounds) == (1000, 150, 1175, 400) and m.crs.code == "25832" and m.is_tiled and m.color_model == "RGB"
    assert [(o.level, o.w, o.decx) for o in m.overviews] == [(1, 35, 2)] and [b.color for b in m.bands] == ["Red", "Green", "Blue"] and m.bands[0].nodata == 7
    level, clipped, data = readers.read_window(path, (30, 20, 12, 14), 12, 14)
    out = np.frombuffer(data, np.uint8).reshape(14, 12, 4)
    assert level == 0 and (out[..., :3] == a[20:34, 30:42]).all() and (out[..., 3] == 255).all()
    level, _, data = readers.read_window(path, (0, 0, 70, 50), 7, 5)
    assert level == 1 and tuple(data[:3]) == plaid(4, 4)
    assert readers.read_window(path, (66, 45, 9, 9), 4, 4)[1] == (66, 45, 4, 5)
    with pytest.raises(ValueError):
        readers.read_window(path, (80, 0, 2, 2), 1, 1)
    assert readers.read_blocks(spark, path, window=(0, 0, 32, 33)).count() == 2


def test_windows_read_little_of_a_large_file(tmp_path, monkeypatch):
    a = np.random.default_rng(0).integers(0, 255, (1500, 1500, 3)).astype(np.uint8)
    path = str(tmp_path / "l.tif")
    (tmp_path / "l.tif").write_bytes(geotiff.encode([(a, 2)], tile=128, tags=KEYS))
    read = []
    real = files.opened

    @contextlib.contextmanager
    def counted(p):
        with real(p) as fetch:
            yield lambda offset, length: (read.append(length), fetch(offset, length))[1]

    monkeypatch.setattr(files, "opened", counted)
    _, _, data = readers.read_window(path, (300, 300, 50, 50), 50, 50)
    assert (np.frombuffer(data, np.uint8).reshape(50, 50, 4)[..., :3] == a[300:350, 300:350]).all()
    assert sum(read) < files.size(path) / 50
    read.clear()
    parts = readers.BlockReader({"path": path, "window": "300,300,50,50"}).partitions()
    assert sum(read) < files.size(path) / 50 and len(parts) == 1
    read.clear()
    assert len(list(readers.BlockReader({"path": path}).read(parts[0]))) == 1 and sum(read) < files.size(path) / 50


@pytest.mark.parametrize("compression", [1, 8])
def test_geotiff_strips(tmp_path, compression):
    a = ramp(21, 13, plaid)
    (tmp_path / "s.tif").write_bytes(geotiff.encode([(a, 2)], strip_rows=5, compression=compression, tags=KEYS))
    out = np.frombuffer(readers.read_window(str(tmp_path / "s.tif"), (6, 4, 9, 7), 9, 7)[2], np.uint8).reshape(7, 9, 4)
    assert (out[..., :3] == a[4:11, 6:15]).all()


@pytest.mark.parametrize("planar", [False, True])
@pytest.mark.parametrize("bands,photometric", [(1, 0), (1, 1), (2, 1), (3, 2), (4, 2), (4, 5), (3, 6)])
def test_samples_of_8_and_16_bits(tmp_path, bands, photometric, planar):
    a = np.random.default_rng(bands).integers(0, 256, (9, 11, bands)).astype(np.uint8)
    tags = {geotiff.SUBSAMPLING: (3, [1, 1])}
    path = str(tmp_path / "b.tif")
    got = []
    for wide in (a, a.astype(np.uint16) << 8 | 77):
        (tmp_path / "b.tif").write_bytes(geotiff.encode([(wide, photometric)], strip_rows=4, tags=tags, planar=planar))
        got.append(np.frombuffer(readers.read_window(path, (0, 0, 11, 9), 11, 9)[2], np.uint8).reshape(9, 11, 4))
    assert (got[0] == got[1]).all()
    f = a.astype(float)
    if photometric in (0, 1):
        want = np.repeat(255 - f[..., :1] if photometric == 0 else f[..., :1], 3, axis=2)
    elif photometric == 2:
        want = f[..., :3]
    elif photometric == 5:
        want = np.floor((255 - f[..., :3]) * (255 - f[..., 3:]) / 255)
    else:
        y, b, r = f[..., 0], f[..., 1] - 128, f[..., 2] - 128
        want = np.clip(np.rint(np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], axis=2)), 0, 255)
    assert (got[0][..., :3] == want).all()
    assert (got[0][..., 3] == (a[..., -1] if (bands, photometric) in ((2, 1), (4, 2)) else 255)).all()


def test_samples_of_few_bits_and_others(tmp_path):
    d = geotiff.Directory({geotiff.WIDTH: (5,), geotiff.HEIGHT: (2,), geotiff.BITS: (1,), geotiff.PHOTOMETRIC: (1,)}, "<")
    assert geotiff.rgba(d, [bytes([0b10110000, 0b01000000])], 5, 2)[..., 0].tolist() == [[255, 0, 255, 255, 0], [0, 255, 0, 0, 0]]
    d = geotiff.Directory({geotiff.BITS: (4,), geotiff.PHOTOMETRIC: (1,)}, "<")
    assert geotiff.rgba(d, [bytes([0x0F, 0x30])], 3, 1)[..., 0].tolist() == [[0, 255, 51]]
    for tags in ({geotiff.BITS: (32,)}, {geotiff.BITS: (16,), geotiff.FORMAT: (3,)}, {geotiff.BITS: (8, 16)}):
        with pytest.raises(G.Unsupported):
            geotiff.rgba(geotiff.Directory(tags, "<"), [bytes(64)], 2, 2)


def test_a_read_ends_when_nobody_waits(tmp_path):
    (tmp_path / "c.tif").write_bytes(geotiff.encode([(ramp(64, 64, plaid), 2)], tile=16))
    left = iter([True, True, False])
    with pytest.raises(geotiff.Cancelled):
        readers.read_window(str(tmp_path / "c.tif"), (0, 0, 64, 64), 64, 64, lambda: next(left))


def test_pixel_is_point(spark, tmp_path):
    a = ramp(6, 2, plaid)
    tags = KEYS | {geotiff.GEOKEYS: (3, [1, 1, 0, 1, 1025, 0, 1, 2])}
    (tmp_path / "p.tif").write_bytes(geotiff.encode([(a, 2)], tags=tags))
    m = readers.raster_layers(spark, str(tmp_path / "p.tif")).first()
    assert tuple(m.geotransform) == (998.75, 2.5, 0, 402.5, 0, -5) and tuple(m.bounds) == (998.75, 392.5, 1013.75, 402.5) and m.pixel_anchor == "Point"


def test_other_compressions():
    assert geotiff.packbits(bytes([2, 1, 2, 3, 254, 9, 128])) == bytes([1, 2, 3, 9, 9, 9])
    codes = [256, 7, 8, 258, 258, 257]  # clear, 7, 8, then 7 8 twice, end
    bits = "".join(f"{c:09b}" for c in codes)
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert geotiff.lzw(packed) == bytes([7, 8, 7, 8, 7, 8])
    with pytest.raises(G.Unsupported):
        geotiff.unpacked(b"", 7)


def test_world_image(spark, tmp_path):
    a = ramp(21, 13, plaid)
    rgba = np.dstack([a, np.full((13, 21), 200, np.uint8)])
    (tmp_path / "r.png").write_bytes(worldimage.encode_png(rgba))
    (tmp_path / "r.pgw").write_text("4\n-1.5\n0.75\n-2\n52.375\n80.25\n")
    (tmp_path / "r.prj").write_text('GEOGCS["Base",AUTHORITY["EPSG","4258"]]')
    m = readers.raster_layers(spark, str(tmp_path / "r.png")).first()
    assert tuple(m.geotransform) == (50, 4, 0.75, 82, -1.5, -2) and m.band_count == 4 and m.color_model == "RGBA" and m.crs.code == "4258"
    out = np.frombuffer(readers.read_window(str(tmp_path / "r.png"), (6, 4, 9, 7), 9, 7)[2], np.uint8).reshape(7, 9, 4)
    assert (out == rgba[4:11, 6:15]).all()
    with pytest.raises(G.Malformed, match="six"):
        worldimage.affine("1 2 3 4 5")


def png_file(kind, depth, a, interlace=False, extra=b""):
    """A PNG of samples (h, w, bands) of ``depth`` bits, every row with the next filter."""
    import zlib

    h, w, bands = a.shape

    def packed(part):
        if depth == 16:
            return part.astype(">u2").tobytes()
        if depth == 8:
            return part.astype(np.uint8).tobytes()
        bits = (part.reshape(-1)[:, None] >> np.arange(depth - 1, -1, -1)) & 1
        return np.packbits(bits.reshape(-1).astype(np.uint8)).tobytes()

    raw, step = b"", max(1, bands * depth // 8)
    for x0, y0, dx, dy in worldimage.PASSES if interlace else ((0, 0, 1, 1),):
        part = a[y0::dy, x0::dx]
        if not part.size:
            continue
        last = bytes(len(packed(part[0])))
        for n, line in enumerate(part):
            line, how = packed(line), n % 5
            out = bytearray()
            for i, v in enumerate(line):
                left, up, corner = (line[i - step] if i >= step else 0), last[i], (last[i - step] if i >= step else 0)
                out.append((v - (0, left, up, (left + up) // 2, worldimage._paeth(left, up, corner))[how]) & 255)
            raw, last = raw + bytes([how]) + bytes(out), line
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, int(interlace))) + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlace", [False, True])
@pytest.mark.parametrize("kind,depth", [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (4, 8), (4, 16), (6, 8), (6, 16)])
def test_png_of_any_depth(kind, depth, interlace):
    rng = np.random.default_rng(depth)
    for h, w in ((13, 21), (1, 1), (3, 2), (9, 5)):
        a = rng.integers(0, 1 << depth, (h, w, worldimage.PNG_BANDS[kind]))
        eight = a >> 8 if depth == 16 else a * 255 // ((1 << depth) - 1)
        got = worldimage.png(png_file(kind, depth, a, interlace))
        gray = kind in (0, 4)
        assert (got[..., :3] == (eight[..., :1] if gray else eight[..., :3])).all()
        assert (got[..., 3] == (eight[..., -1] if kind in (4, 6) else 255)).all()


def test_jpeg_pixels_and_the_cache_of_images(spark, tmp_path, monkeypatch):
    image = spark._jvm.java.awt.image.BufferedImage(32, 16, 1)
    for x in range(32):
        for y in range(16):
            image.setRGB(x, y, 0x304050 if x < 16 else 0xC0A080)
    spark._jvm.javax.imageio.ImageIO.write(image, "jpg", spark._jvm.java.io.File(str(tmp_path / "j.jpg")))
    (tmp_path / "j.jgw").write_text("4\n-1.5\n0.75\n-2\n52.375\n80.25\n")
    (tmp_path / "p.png").write_bytes(worldimage.encode_png(ramp(4, 4, plaid)))
    path = str(tmp_path / "j.jpg")
    m = readers.raster_layers(spark, path).first()
    assert (m.width, m.height, m.band_count, m.color_model) == (32, 16, 3, "RGB")
    out = np.frombuffer(readers.read_window(path, (2, 2, 28, 10), 28, 10)[2], np.uint8).reshape(10, 28, 4).astype(int)
    assert abs(out[:, 0, :3] - (0x30, 0x40, 0x50)).max() < 6 and abs(out[:, -1, :3] - (0xC0, 0xA0, 0x80)).max() < 6 and (out[..., 3] == 255).all()
    got = {r.path: (r.w, r.h, len(r.pixels)) for r in readers.read_images(spark, str(tmp_path)).collect()}
    assert got == {path: (32, 16, 2048), str(tmp_path / "p.png"): (4, 4, 64)}
    monkeypatch.setattr(readers, "SparkSession", None)  # the second read decodes nothing
    assert readers.read_window(path, (0, 0, 1, 1), 1, 1)[1] == (0, 0, 1, 1)


def test_a_folder_of_files_is_one_table(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"f{n}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "id": i, "geometry": {"type": "Point", "coordinates": [i % 64, i // 64]}, "properties": {"index": i}} for i in range(n * 100, n * 100 + 100)]}))
    f = readers.read_features(spark, str(tmp_path), format="geojson")
    assert f.count() == 300 and f.agg(F.max("minx")).first()[0] == 63
