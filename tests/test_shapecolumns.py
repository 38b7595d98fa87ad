"""Shapefiles by column: the same as record by record, whatever the records are, in bounded memory."""

import datetime
import decimal
import json
import random
import struct

import numpy as np
import pyarrow as pa
import pytest

from terraframe.plans import source_queries
from terraframe.sources import files, geometry as G, readers, shapecolumns, shapefile, writers


def shapes(n, seed=5, families=("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", None)):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        z, m = rnd.random() < 0.4, rnd.random() < 0.4

        def p():
            return (rnd.choice([0.0, 1.5, -7.25, 1e300]), rnd.uniform(-9, 9), rnd.uniform(0, 5) if z else None, rnd.choice([None, 2.5]) if m else None)

        kind = rnd.choice(families)
        ring = lambda least=0: [p() for _ in range(rnd.randint(least, 5))]
        parts = {"Point": lambda: [[[p()]]], "MultiPoint": lambda: [[[p()]] for _ in range(rnd.randint(0, 4))], "LineString": lambda: [[ring()]], "MultiLineString": lambda: [[ring()] for _ in range(rnd.randint(2, 4))], "Polygon": lambda: [[ring() for _ in range(rnd.randint(1, 3))]]}
        out.append(kind and G.single(kind, parts[kind]()))
    return out


def by_record(data, at, lengths, first, extent):
    for k, (o, n) in enumerate(zip(at.tolist(), lengths.tolist())):
        g = G.shape(shapefile.record(data[o : o + 8 + n], first + k, n))
        if extent is None or G.intersects(G.shape_bounds(data[o + 8 : o + 44]), extent) and G.intersects(G.bounds(g), extent):
            yield k, g, G.bounds(g)


@pytest.mark.parametrize("extent", [None, (-8.0, -3.0, 2.0, 4.0), (500.0, 500.0, 501.0, 501.0)])
def test_decoding_by_column_equals_record_by_record(extent):
    shp, shx = shapefile.encode_shapes(shapes(400))
    index = np.array(shapefile.entries(shx))
    kept, geometry, declared, sides = shapecolumns.decode(shp, index[:, 0], index[:, 1], 1, extent)
    want = list(by_record(shp, index[:, 0], index[:, 1], 1, extent))
    assert kept.tolist() == [k for k, _, _ in want] and (extent is None) == (len(want) == 400)
    assert geometry.to_pylist() == G.as_array([g for _, g, _ in want], shapecolumns.GEOMETRY).to_pylist()
    assert declared.to_pylist() == [g and g["members"][0]["declared"] for _, g, _ in want]
    assert [s.to_pylist() for s in sides] == [[b and b[k] for _, _, b in want] for k in range(4)]
    geometry.validate(full=True)


def test_records_are_what_the_format_says():
    line = G.single("MultiLineString", [[[(1.0, 2.0, 5.0, None), (3.0, -4.0, 7.0, 0.5)]], [[(9.0, 9.0, 6.0, None)]]])
    kind, content = shapefile._content(line)
    assert kind == 13 and content == struct.pack("<i4d2i2i6d2d3d2d3d", 13, 1, -4, 9, 9, 2, 3, 0, 2, 1, 2, 3, -4, 9, 9, 5, 7, 5, 7, 6, -1e39, 0.5, -1e39, 0.5, -1e39)
    assert shapefile._content(G.single("Point", [[[(1.0, 2.0, None, 4.0)]]])) == (21, struct.pack("<i3d", 21, 1, 2, 4))
    assert shapefile._content(None) == (0, struct.pack("<i", 0))
    with pytest.raises(G.Malformed):
        shapefile._content(G.single("Point", [[[(1.0, 2.0, None, None), (1.0, 2.0, None, None)]]]))


def test_slices_of_a_column_are_encoded():
    found = shapes(60, seed=8)
    column = G.as_array(found, shapecolumns.GEOMETRY)
    r = shapecolumns.encode(column.slice(20, 25))
    assert r.numbered(1) == shapecolumns.encode(G.as_array(found[20:45], shapecolumns.GEOMETRY)).numbered(1)


def test_irregular_records_are_left_to_the_plain_way():
    shp, shx = shapefile.encode_shapes(shapes(6, families=("LineString",)))
    index = np.array(shapefile.entries(shx))
    for at, form, v in ((0, ">i", 7), (8, "<i", 77), (8 + 36, "<i", -1), (8 + 40, "<i", 10**6), (8 + 44, "<i", 3)):
        data = bytearray(shp)
        struct.pack_into(form, data, int(index[2, 0]) + at, v)
        assert shapecolumns.decode(bytes(data), index[:, 0], index[:, 1], 1, None) is None


FIELDS = [("C", "C", 6, 0), ("N", "N", 9, 0), ("D", "N", 12, 3), ("E", "N", 14, 8), ("L", "L", 1, 0), ("T", "D", 8, 0), ("I", "I", 4, 0), ("Y", "Y", 8, 0)]


def test_table_columns_equal_values_one_by_one():
    rows = [{"C": "é" * (k % 4), "N": k - 2, "D": decimal.Decimal(k) / 8, "E": decimal.Decimal(k).scaleb(-8), "L": k % 3 == 0, "T": datetime.date(1987 + k, 2, 3), "I": -k, "Y": decimal.Decimal(k) / 4} if k % 5 else {} for k in range(12)]
    data = bytearray(shapefile.encode_table(FIELDS, rows))
    t = shapefile.table(bytes(data))
    for k, text in ((1, b"007"), (2, b"1.0"), (3, b" +5 "), (4, b"0x1")):
        assert len(text) <= 9
        if k != 4:
            at = t.start + k * t.width + t.fields[1].offset
            data[at : at + 9] = text.ljust(9)
    raw, there = shapecolumns.records(bytes(data[t.start :]), t, 12)
    one = [shapefile.row(r.tobytes(), t, "utf-8") for r in raw]
    assert there.all()
    texts = shapecolumns.as_json(raw, t, "utf-8").to_pylist()
    assert texts == ["{" + ",".join(json.dumps(n) + ":" + shapecolumns._dumped(v) for n, v in r.items()) + "}" for r in one]
    plain = shapecolumns.as_json(raw[5:], t, "utf-8").to_pylist()
    assert plain == texts[5:]
    kinds = [pa.string(), pa.int64(), pa.decimal128(12, 3), pa.decimal128(14, 8), pa.bool_(), pa.date32(), pa.int32(), pa.decimal128(19, 4)]
    columns = [c.to_pylist() for c in shapecolumns.as_columns(raw[5:], t, "utf-8", kinds)]
    assert list(zip(*columns)) == [tuple(r.values()) for r in one[5:]]
    with pytest.raises(G.Malformed):
        at = t.start + 4 * t.width + t.fields[1].offset
        data[at : at + 9] = b"0x1".ljust(9)
        shapecolumns.as_json(shapecolumns.records(bytes(data[t.start :]), t, 12)[0], t, "utf-8")


def test_typed_columns_are_written_as_their_values_one_by_one():
    rows = [{"C": "ab\0c"[: k % 5], "N": k * 1001 - 5, "D": k / 7, "E": None, "L": k % 2 == 0, "T": datetime.date(2001, 1, 1 + k), "I": k, "Y": None} if k % 4 else dict.fromkeys("CNDELTIY") for k in range(11)]
    kinds = dict(zip("CNDELTIY", [pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.date32(), pa.int64(), pa.decimal128(9, 2)]))
    batch = pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))
    whole = shapefile.encode_table(FIELDS, rows)
    assert shapefile.encode_head(FIELDS, 11) + shapecolumns.encode_rows(FIELDS, batch, "utf-8") + b"\x1a" == whole
    with pytest.raises(G.Malformed, match="fit"):
        shapecolumns.encode_rows([("N", "N", 3, 0)], batch, "utf-8")


def test_a_large_partition_becomes_several_files_and_is_read_in_chunks(spark, tmp_path, monkeypatch):
    """What a task holds at once doesn't grow with its partition."""
    monkeypatch.setattr(writers, "FILE_BYTES", 20_000)
    found = shapes(900, seed=2, families=("Polygon", None))
    table = pa.table({"id": pa.array(range(900)), "geometry": G.as_array(found, shapecolumns.GEOMETRY)})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        df = spark.createDataFrame(table).coalesce(1)
        names = writers.write_features(df, str(tmp_path / "s"), "shapefile", fields=[("id", "N", 18, 0)])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(names) > 3
    part = readers.Part(f"{tmp_path}/s/{names[0]}.shp", None, 0, 100)
    monkeypatch.setattr(readers, "CHUNK_BYTES", 1500)
    batches = list(readers._shapefile_batches(part, None))
    assert len(batches) > 5 and sum(b.num_rows for b in batches) == 100
    got = {json.loads(r.attributes)["id"]: r.geometry and len(r.geometry.members[0].parts[0]) for r in readers.read_features(spark, str(tmp_path / "s"), format="shapefile").collect()}
    assert got == {i: g and len(g["members"][0]["parts"][0]) for i, g in enumerate(found)}
    assert len(files.expand(str(tmp_path / "s"), (".dbf",))) == len(names)


@pytest.fixture
def no_single_records(monkeypatch):
    """Nothing is encoded, decoded or turned into Python values record by record."""

    def fail(*_):
        raise AssertionError("a record is handled by itself")

    for where, name in ((G, "shape"), (G, "positions"), (G, "as_array"), (shapefile, "row"), (shapefile, "record"), (writers, "_values")):
        monkeypatch.setattr(where, name, fail)


def there_and_back(found, folder):
    """The geometries, written as a column and read as a column, in this process."""
    column = G.as_array(found, shapecolumns.GEOMETRY)

    def run():
        s = shapefile.Shapes()
        for k in range(0, len(column), 7):
            s.add(shapecolumns.encode(column.slice(k, 7)))
        shp, shx = s.files()
        (folder / "a.shp").write_bytes(shp)
        (folder / "a.shx").write_bytes(shx)
        (folder / "a.dbf").write_bytes(shapefile.encode_table([("ID", "N", 9, 0)], [{"ID": k} for k in range(len(column))]))
        batches = list(readers._shapefile_batches(readers.Part(str(folder / "a.shp"), None, 0, len(column)), None))
        return pa.Table.from_batches(batches)

    return run


def test_multipoints_are_written_and_read_by_column(tmp_path, request):
    found = shapes(80, families=("MultiPoint",))
    run = there_and_back(found, tmp_path)
    request.getfixturevalue("no_single_records")
    got = run()
    assert [len(g["members"][0]["parts"]) for g in got["geometry"].to_pylist()] == [len(g["members"][0]["parts"]) for g in found]


def test_all_tables_of_a_folder_are_one_source(spark, tmp_path):
    """One plan for any number of tables; their rows in the order of the names."""
    fields = [("N", "N", 9, 0), ("D", "N", 9, 2)]
    for k in range(30):
        (tmp_path / f"t{k:02}.dbf").write_bytes(shapefile.encode_table(fields, [{"N": k, "D": None}, None, {"N": -k, "D": decimal.Decimal(k)}]))
    df = readers.read_dbf(spark, str(tmp_path))
    assert df._jdf.queryExecution().logical().collectLeaves().size() == 1
    got = [(r.record_no, r.deleted, r.N, r.D) for r in df.collect()]
    assert got == [x for k in range(30) for x in ((0, False, k, None), (1, True, None, None), (2, False, -k, decimal.Decimal(k)))]
    (tmp_path / "t99.dbf").write_bytes(shapefile.encode_table([("N", "N", 9, 0)], []))
    with pytest.raises(Exception, match="t99.dbf: its fields differ"):
        readers.read_dbf(spark, str(tmp_path)).collect()


def test_points_with_z_are_written_and_read_by_column(tmp_path, request):
    found = [G.single("Point", [[[(float(k), -k / 2, k / 4, None)]]]) for k in range(60)]
    run = there_and_back(found, tmp_path)
    request.getfixturevalue("no_single_records")
    got = run()
    assert got["minx"].to_pylist() == list(range(60)) and [g["members"][0]["parts"][0][0][0]["z"] for g in got["geometry"].to_pylist()] == [k / 4 for k in range(60)]


def test_polygons_are_written_and_read_by_column(tmp_path, request):
    found = shapes(80, seed=6, families=("Polygon",))
    run = there_and_back(found, tmp_path)
    request.getfixturevalue("no_single_records")
    got = run()
    assert [[len(r) for r in g["members"][0]["parts"][0]] for g in got["geometry"].to_pylist()] == [[len(r) for r in g["members"][0]["parts"][0]] for g in found]


def test_ranges_of_a_shapefile_go_by_bytes(tmp_path, monkeypatch):
    """Many small records are one partition; a long file is cut into ranges that hold each record once."""
    n = 120_000
    column = pa.StructArray.from_arrays([pa.nulls(n, t.type) for t in shapecolumns.GEOMETRY], fields=list(shapecolumns.GEOMETRY), mask=pa.array(np.ones(n, bool)))
    s = shapefile.Shapes()
    s.add(shapecolumns.encode(column))
    for extension, data in zip(("shp", "shx", "dbf"), (*s.files(), shapefile.encode_head([("ID", "N", 1, 0)], n) + b" 1" * n + b"\x1a")):
        (tmp_path / f"a.{extension}").write_bytes(data)
    reader = readers.FeatureReader({"kind": "shapefile", "path": str(tmp_path / "a.shp")})
    ranges = lambda: [(p.first, p.last) for p in reader.partitions()]
    assert ranges() == [(0, n)]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == n
    for name, value in (("PARTITION_BYTES", 100_000), ("MOST_ROWS", 7_001)):
        with monkeypatch.context() as m:
            m.setattr(readers, name, value)
            cut = ranges()
            assert len(cut) > 10 and cut[0][0] == 0 and cut[-1][1] == n and all(a[1] == b[0] for a, b in zip(cut, cut[1:]))


def dealt(spark, tmp_path, monkeypatch, query):
    """Rows of a query on a table of one row group, and the files that it writes on the way."""
    monkeypatch.setattr(source_queries, "scratch", lambda spark: str(tmp_path))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return query(spark, "/root/testdata/sf0.001").count(), len(list(tmp_path.glob("*.shp")))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_polygons_of_one_row_group_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    rows, n = dealt(spark, tmp_path, monkeypatch, source_queries.shapefile_polygons)
    assert rows == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count() and n == 4


def test_points_of_one_row_group_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    rows, n = dealt(spark, tmp_path, monkeypatch, source_queries.shapefile_scan)
    assert rows == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count() and n == 4
