"""The paged source and the document writer."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from spokeline.sources import geojson, paged

ROWS = "page int, pos int, highway string, max_lat double, min_lng double"


def feature(highway, *points):
    return {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [list(p) for p in points]}, "properties": {"highway": highway, "lanes": 2}}


def page(folder, n, features, more):
    (folder / f"page={n}").mkdir(parents=True)
    (folder / f"page={n}" / "part-0.txt").write_text(json.dumps({"type": "FeatureCollection", "features": features, "exceededTransferLimit": more}))


def test_stop_rule_and_chosen_columns(spark, tmp_path):
    one = feature("primary", (-122.5, 45.5), (-122.6, 45.6, 9))
    page(tmp_path, 0, [one] * 3, False)  # full, so more may follow
    page(tmp_path, 1, [one], True)  # the server says so
    page(tmp_path, 2, [one, {"type": "Feature", "geometry": None, "properties": {}}], False)  # the end
    page(tmp_path, 10, [one] * 3, False)
    rows = paged.read(spark, str(tmp_path), ROWS, page_size=3)
    got = sorted(tuple(r) for r in rows.collect())
    assert [g[:2] for g in got] == [(0, 0), (0, 1), (0, 2), (1, 0), (2, 0), (2, 1)]
    assert got[0][2:] == ("primary", 45.6, -122.6) and got[-1][2:] == (None, None, None)
    assert rows.rdd.getNumPartitions() == 3
    whole = paged.read(spark, str(tmp_path), "page int, lanes long", page_size=2)  # the first page that is not full and says nothing is none: all are read
    assert whole.select("lanes").distinct().count() == 2 and {r["page"] for r in whole.collect()} == {0, 1, 2, 10}


def test_an_empty_page_ends_it(spark, tmp_path):
    page(tmp_path, 0, [feature("a", (1, 2))], True), page(tmp_path, 1, [], True), page(tmp_path, 2, [feature("b", (1, 2))], True)
    assert [r["highway"] for r in paged.read(spark, str(tmp_path), "highway string").collect()] == ["a"]
    assert paged.read(spark, str(tmp_path), "page int, features int").orderBy("page").collect()[-1]["features"] == 0


def test_filters_reach_the_source(spark, tmp_path):
    page(tmp_path, 0, [feature("primary", (-122.5, 45.5)), feature("footway", (-122.5, 45.5)), feature("primary", (-120.0, 44.0))], True)
    page(tmp_path, 1, [feature("trunk", (-122.5, 45.7)), feature(None, (-122.5, 45.7))], True)
    rows = paged.read(spark, str(tmp_path), ROWS).where(F.col("highway").isin("primary", "trunk") & (F.col("max_lat") >= 45.0) & (F.col("min_lng") < -121))
    plan = rows._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "BatchScan paged_features" in physical and "Filter (" not in physical  # nothing is left for Spark to test
    assert sorted((r["page"], r["pos"]) for r in rows.collect()) == [(0, 0), (1, 0)]
    left = paged.read(spark, str(tmp_path), ROWS).where("highway like 'pri%' or page = 1")  # what the source cannot test stays with Spark
    assert left.count() == 4
    reader = paged.PagedReader(rows.schema, {"path": str(tmp_path)})
    assert list(reader.pushFilters([paged.EqualTo(("page",), 1)])) == [] and [p.number for p in reader.partitions()] == [1]  # other pages are not opened


def test_one_document(spark, tmp_path):
    v = spark.range(50).repartition(5).select(F.struct(F.lit("Point").alias("type"), F.array(F.col("id") * 0.5, F.lit(45.0)).alias("coordinates")).alias("geometry"), F.struct(F.concat(F.lit('a"b'), F.col("id").cast("string")).alias("name")).alias("properties"))
    path = tmp_path / "out.geojson"
    paged.write_document(v, str(path))
    document = json.loads(path.read_text())
    assert document["type"] == "FeatureCollection" and sorted(f["geometry"]["coordinates"][0] for f in document["features"]) == [k * 0.5 for k in range(50)]
    assert not (tmp_path / "out.geojson.parts").exists()
    assert geojson.features(spark, str(path)).select("name").distinct().count() == 50
    paged.write_document(v.limit(0), str(path))
    assert json.loads(path.read_text())["features"] == []


def test_a_document_is_read_in_parts(spark, tmp_path):
    v = spark.range(3000).select(F.struct(F.lit("LineString").alias("type"), F.array(F.array(F.col("id") * 0.5, F.lit(45.0)), F.array(F.lit(1.5), F.lit(2.0))).alias("coordinates")).alias("geometry"), F.struct(F.concat(F.lit('a"},\n{'), F.col("id").cast("string")).alias("StreetName")).alias("properties"))
    path = str(tmp_path / "out.geojson")
    paged.write_document(v.repartition(3), path)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        parts = geojson.document(spark, path)
        assert parts.rdd.getNumPartitions() > 3  # a file read as a whole is one
        rows = lambda df: sorted(map(tuple, df.select("type", "coordinates", "StreetName", "ConnectionType").collect()), key=str)
        assert rows(parts) == rows(geojson.features(spark, path)) and parts.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    paged.write_document(v.limit(0), path)
    assert geojson.document(spark, path).count() == 0
