"""Streams give what a batch over the same rows gives."""

import json

from pyspark.sql import functions as F


def test_latest_requests(spark, tmp_path):
    from terraframe.streaming.requests import latest_requests

    rows = [(v, f"2024-01-01 00:00:{s:02d}", f"r{s}") for s in range(0, 40, 3) for v in ("a", "b") if (s + ord(v)) % 2]
    spark.createDataFrame(rows, "viewport string, at string, request string").withColumn("at", F.to_timestamp("at")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("viewport string, at timestamp, request string").parquet(str(tmp_path / "in"))
    stream = latest_requests(source, every="10 seconds").writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    stream.awaitTermination(60)
    got = {(r.viewport, r.window.start.second): r.request for r in spark.table("latest").collect()}
    want = {}
    for v, at, request in rows:
        want[v, int(at[-2:]) // 10 * 10] = request
    assert got == want


def test_arriving_features(spark, tmp_path):
    from terraframe.sources import readers
    from terraframe.streaming.requests import arriving_features

    (tmp_path / "in").mkdir()
    for n in range(3):
        features = [{"type": "Feature", "id": f"{n}-{i}", "geometry": {"type": "Point", "coordinates": [i, n]}, "properties": {"i": i}} for i in range(5)]
        (tmp_path / "in" / f"f{n}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    stream = arriving_features(spark, str(tmp_path / "in"), extent=(1, 0, 3, 1), files_per_trigger=1).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    stream.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).select("layer", "seq", "feature_id", "attributes").collect()
    want = readers.read_features(spark, str(tmp_path / "in"), format="geojson", extent=(1, 0, 3, 1)).select("layer", "seq", "feature_id", "attributes").collect()
    assert sorted(got) == sorted(want) and len(got) == 6
