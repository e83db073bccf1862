"""GeoJSON reading, and streams replayed against the batch form."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from spokeline.sources import geojson
from spokeline.streaming import navigation as live


def test_geojson_depths(spark, tmp_path):
    features = [
        {"geometry": {"type": "LineString", "coordinates": [[-122.6, 45.4], [-122.61, 45.41, 7]]}, "properties": {"ConnectionType": "NG"}},
        {"geometry": {"type": "MultiLineString", "coordinates": [[[-122.6, 45.4], [-122.6, 45.5]], [[-122.7, 45.4]]]}, "properties": {"StreetName": "x"}},
        {"geometry": {"type": "Point", "coordinates": [-122.6, 45.4]}, "properties": {}},
        {"geometry": None, "properties": {}},
    ]
    (tmp_path / "net.json").write_text(json.dumps({"features": features}))
    rows = geojson.features(spark, str(tmp_path / "net.json")).withColumn("sid", F.col("pos"))
    v = sorted((r["sid"], r["part"], r["seq"], r["lat"], r["lng"], r["ele"]) for r in geojson.vertices(rows).collect())
    assert v == [(0, 0, 0, 45.4, -122.6, 0.0), (0, 0, 1, 45.41, -122.61, 7.0), (1, 0, 0, 45.4, -122.6, 0.0), (1, 0, 1, 45.5, -122.6, 0.0), (1, 1, 0, 45.4, -122.7, 0.0)]
    assert geojson.rejected(rows).count() == 1


def test_pages_stop(spark, tmp_path):
    def page(n, size, more):
        (tmp_path / f"{n}.json").write_text(json.dumps({"features": [{"geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {}}] * size, "exceededTransferLimit": more}))

    page(0, 3, False), page(1, 1, True), page(2, 2, False), page(3, 3, False)
    got = geojson.pages(spark, str(tmp_path), page_size=3).groupBy("page").count().collect()
    assert {r["page"]: r["count"] for r in got} == {0: 3, 1: 1, 2: 2}


def test_roads_stay_whole_and_features_are_written(spark, tmp_path):
    rows = [(1, 0, "primary", 45.0, -122.0), (1, 1, "primary", 46.0, -122.0), (2, 0, "primary", 46.0, -122.0), (3, 0, "footway", 45.0, -122.0)]
    v = spark.createDataFrame(rows, "road long, seq int, highway string, lat double, lng double")
    assert sorted((r["road"], r["seq"]) for r in geojson.roads_in(v, (44.9, -122.1, 45.1, -121.9)).collect()) == [(1, 0), (1, 1)]
    out = v.select(F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates")).alias("geometry"), F.struct("highway").alias("properties"))
    geojson.write_collection(out, str(tmp_path / "out"))
    back = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(back) == 4 and all(f["type"] == "Feature" and len(f["geometry"]["coordinates"]) == 2 for f in back)


def test_stream_equals_replay(spark, tmp_path):
    rows = [(1, i, 1_700_000_000 + 5 * i, 0 if i < 6 else 1, "Turn left", 100.0 - 12 * i if i < 8 else 5.0, 200.0 - 20 * i, False) for i in range(10)]
    df = spark.createDataFrame(rows, "rider_id long, event_id long, s long, idx int, next_text string, to_turn_m double, remaining_m double, off_route boolean")
    df = df.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = live.tracked(stream).writeStream.format("memory").queryName("said").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: (r["event_id"], r["idx"], r["arrived"], r["said"])
    got, want = sorted(map(key, spark.table("said").collect()), key=str), sorted(map(key, live.replay(df).collect()), key=str)
    assert got == want and any(r[3] and r[3].startswith("In ") for r in got) and any(r[2] for r in got)


def test_load_goes_on_without_roads_but_not_without_a_network(spark, tmp_path):
    line = {"geometry": {"type": "LineString", "coordinates": [[-122.6, 45.4], [-122.61, 45.41]]}, "properties": {"ConnectionType": "NG", "highway": "primary"}}
    (tmp_path / "net.json").write_text(json.dumps({"features": [line]}))
    for roads in (None, str(tmp_path / "roads.json")):
        net, none = geojson.load(spark, str(tmp_path / "net.json"), roads)
        assert net.count() == 1 and none.count() == 0 and none.schema == net.schema
    (tmp_path / "roads.json").write_text(json.dumps({"features": [line, line]}))
    assert geojson.load(spark, str(tmp_path / "net.json"), str(tmp_path / "roads.json"))[1].count() == 2
    with pytest.raises(FileNotFoundError):
        geojson.load(spark, str(tmp_path / "gone.json"), str(tmp_path / "roads.json"))
