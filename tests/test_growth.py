"""Work that grows no faster than the input: groups, pairs and neighbours met once."""

from __future__ import annotations

import math
import random
import re

from pyspark.sql import functions as F

from spokeline.functions import geo
from spokeline.operators import navigation, places, preferences, spatial
from spokeline.plans import fixtures


def rows_of(spark, df):
    """Rows that each operator of the executed plan made, by name, most first."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(p):
        metric = p.metrics().get("numOutputRows")
        if metric.isDefined():
            found.append((p.nodeName(), metric.get().value()))
        for name in ("executedPlan", "plan"):  # what adaptive execution hides
            if p.nodeName() in ("AdaptiveSparkPlan",) and name == "executedPlan" or p.nodeName().endswith("QueryStage") and name == "plan":
                walk(getattr(p, name)())
        children = p.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return sorted(found, key=lambda x: -x[1])


def test_a_large_group_is_met_once(spark):
    n = 4000
    k = F.col("insert_seq")
    p = spark.range(n).select((F.col("id") * 50).alias("insert_seq")).select(k, F.format_string("k%05d", k).alias("edge_key"), F.when(k == 50 * (n - 1), "nogo").otherwise("preferred").alias("type"), F.lit("g").alias("group_id"))
    p = p.unionByName(spark.createDataFrame([(10**7, "k00050", "preferred", None), (3, "x", "nogo", None)], "insert_seq long, edge_key string, type string, group_id string"))
    keys = preferences.members(p)
    assert [(r["pos"], r["edge_key"]) for r in keys.orderBy("pos").collect()] == [(i, f"k{i * 50:05d}") for i in range(n)]  # several blocks, numbered on
    out = preferences.overrides(p, keys)
    got = {r["key"]: r["type"] for r in out.collect()}
    assert len(got) == n + 1 and got.pop("k00050") == "preferred" and set(got.values()) == {"nogo"}
    assert max(r for _, r in rows_of(spark, out)) < 4 * n  # not n rows for each of n keys
    left = preferences.remove_members(p, spark.createDataFrame([("k00100",)], "edge_key string"), keys)
    assert {r["edge_key"] for r in left.collect()} == {"x"}
    listed = p.where("insert_seq < 500").join(p.where("insert_seq < 500 and group_id = 'g'").groupBy("group_id").agg(F.sort_array(F.collect_list("edge_key")).alias("all_edge_keys")), "group_id", "left")
    few = preferences.overrides(p.where("insert_seq < 500"), preferences.members(p.where("insert_seq < 500")))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, preferences.overrides(listed).collect()))


def physical(df) -> str:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan


NODES = "node_key string, lat double, lng double, cell_lat long, cell_lng long"


def test_gaps_are_made_without_shuffling_pairs(spark):
    at = [(45.45 + 0.0009 * (i // 6), -122.7 + 0.00115 * (i % 6)) for i in range(36)]
    n = spark.createDataFrame([(f"{a:.4f},{b:.4f}", a, b, math.floor(a * 1000), math.floor(b * 1000)) for a, b in at], NODES)
    keys = [r["node_key"] for r in n.collect()]
    joined = {"|".join(sorted(p)) for p in zip(keys, keys[1:], strict=False)}
    connected = spark.createDataFrame([(k,) for k in [*joined, *joined]], "key string")
    every = spatial.near_pairs(n, n).where("a_key < b_key").collect()
    gaps = spatial.gap_pairs(n, connected)
    assert sorted(r["key"] for r in gaps.collect()) == sorted(r["key"] for r in every if r["key"] not in joined) and gaps.count() < len(every)
    plan = physical(gaps)
    assert "LeftAnti" not in plan  # which would deal all pairs by their key
    road = [(r, 0, 1 + (r == 0), 45.44, -122.6995, 45.47, -122.6995) for r in range(200)]  # roads that lie on each other
    roads = spark.createDataFrame(road, "road long, k int, rank int, lat1 double, lng1 double, lat2 double, lng2 double")
    worst = spatial.worst_crossing(gaps, roads, "key")
    assert {r["rank"] for r in worst.collect()} == {2}
    assert max(r for _, r in rows_of(spark, worst)) < 20 * gaps.count()  # not 200 for each gap


def test_a_fix_stays_one_row(spark):
    v = spark.createDataFrame([(1, i, 45.5 + 0.001 * i, -122.6) for i in range(200)] + [(2, 0, 45.0, -122.0)], "route_id long, idx int, lat double, lng double")
    fixes = spark.createDataFrame([(k, 1 + k // 99, 45.5 + 0.0011 * k, -122.601) for k in range(100)], "event_id long, route_id long, lat double, lng double")
    out = navigation.matched(fixes, navigation.routes_of(v))
    got = {r["event_id"]: r for r in out.collect()}
    assert len(got) == 99 and got[0]["seg"] == 0 and got[3]["seg"] == 3 and abs(got[3]["off_m"] - 77.933) < 0.001 and abs(got[3]["matched_lat"] - 45.5033) < 1e-9
    assert max(r for _, r in rows_of(spark, out)) < 1000  # no fix with each of 199 segments


def test_few_segments_are_worked_out(spark, monkeypatch):
    rng, v, fixes = random.Random(5), [], []
    corners = [(45.5, -122.6, 0.004), (45.5, -122.6, 0.3), (0.0, 179.999, 0.01), (89.9, 10.0, 0.05), (-60.0, -180.0, 3.0), (10.0, 20.0, 0.0)]
    for route in range(36):
        lat, lng, wide = corners[route % 6]
        points = [(lat + (rng.random() - 0.5) * wide, lng + (rng.random() - 0.5) * wide) for _ in range(30)]
        points = [(a, b if b <= 180 else b - 360) for a, b in points]
        points[7] = points[3] = points[4]  # one without length, and a place passed twice
        v += [(route, i, a, b) for i, (a, b) in enumerate(points)]
        for k in range(20):
            a, b = points[k] if k % 3 == 0 else (lat + (rng.random() - 0.5) * wide * 1.3, lng + (rng.random() - 0.5) * wide * 1.3)
            fixes.append((len(fixes), route, *((a, b) if k else (rng.uniform(-90, 90), rng.uniform(-180, 180)))))
    fixes += [(len(fixes), 0, None, 1.0), (len(fixes) + 1, 0, float("nan"), 1.0), (len(fixes) + 2, 0, 1.0, None)]
    routes = navigation.routes_of(spark.createDataFrame(v, "route_id long, idx int, lat double, lng double"))
    df = spark.createDataFrame(fixes, "event_id long, route_id long, lat double, lng double")
    got = sorted(map(repr, navigation.matched(df, routes).collect()))
    left = navigation.candidates(df.where("route_id % 6 = 0 and event_id % 20 > 0").join(routes, "route_id").withColumn("__k", F.cos(geo.rad(F.col("lat")))))
    assert left.agg(F.avg(F.size("segments"))).first()[0] < 20  # of 29, in a tangle whose segments are as long as it is wide
    walk = spark.createDataFrame([(1, i, 45.5 + 0.001 * i, -122.6) for i in range(200)], "route_id long, idx int, lat double, lng double")
    near = navigation.candidates(spark.createDataFrame([(1, 45.5 + 0.0011 * k, -122.601, math.cos(math.radians(45.5))) for k in range(150)], "route_id long, lat double, lng double, __k double").join(navigation.routes_of(walk), "route_id"))
    assert near.agg(F.max(F.size("segments"))).first()[0] < 6  # of 199
    monkeypatch.setattr(navigation, "FLAT_DEG", -1.0)  # then all are worked out
    assert got == sorted(map(repr, navigation.matched(df, routes).collect())) and len(got) == len(fixes)


def test_dense_places_are_not_all_met(spark):
    n = 3000  # of one name, all within a few cells
    p = spark.range(n).select(F.col("id").alias("place_id"), F.lit("Park").alias("name"), (45.45 + (F.col("id") * 131 % 3600) * 1e-5).alias("lat"), (-122.7 + (F.col("id") * 173 % 5700) * 1e-5).alias("lng"))
    q = p.where("place_id % 300 = 7").select(F.col("place_id").alias("query_id"), F.lit("park").alias("text"), *((F.col(x) + s * w).alias(f"{m}_{x}") for x, w in (("lat", 0.008), ("lng", 0.012)) for m, s in (("min", -1), ("max", 1))), (F.col("lat") + 0.001).alias("bias_lat"), F.col("lng").alias("bias_lng"))
    rows = p.collect()

    def metres(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 12742000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    want = {}
    for a in q.collect():
        inside = [r for r in rows if a["min_lat"] <= r["lat"] <= a["max_lat"] and a["min_lng"] <= r["lng"] <= a["max_lng"]]
        want[a["query_id"]] = [r["place_id"] for r in sorted(inside, key=lambda r: (math.floor(metres(r["lat"], r["lng"], a["bias_lat"], a["bias_lng"]) + 0.5), r["place_id"]))[:5]]
    got = {}
    for r in places.search(q, p, p.limit(0)).orderBy("query_id", "rank").collect():
        assert r["tier"] == 1
        got.setdefault(r["query_id"], []).append(r["place_id"])
    assert got == want
    plain = q.drop("bias_lat", "bias_lng").withColumns({"min_lat": F.lit(10.0), "max_lat": F.lit(11.0)})  # no box holds a hit: all ask the same text
    wide = places.search(plain, p, p.limit(0))
    assert sorted((r["tier"], r["place_id"]) for r in wide.where("query_id = 7").collect()) == [(2, k) for k in range(5)] and wide.count() == 50
    points = spark.createDataFrame([(1, 45.46, -122.68), (2, 45.44, -122.7), (3, 46.0, -122.7), (4, 45.4865, -122.645)], "pid long, lat double, lng double")
    near = {r["pid"]: (r["place_id"], r["metres"]) for r in places.nearest(points, p).collect()}
    assert set(near) == {1, 2, 4}  # the third is out of reach
    for r in points.where("pid <> 3").collect():
        d, best = min((metres(r["lat"], r["lng"], x["lat"], x["lng"]), x["place_id"]) for x in rows)
        assert near[r["pid"]][0] == best and abs(near[r["pid"]][1] - d) < 1e-6
    two = p.unionByName(p.withColumn("place_id", F.col("place_id") + n))  # places at the same spot: the first
    assert {r["pid"]: r["place_id"] for r in places.nearest(points, two).collect()} == {k: v[0] for k, v in near.items()}


def test_replayed_edges_need_no_gaps_of_the_whole_network(spark):
    rng = random.Random(7)
    nodes = [(f"{i:03d}", 45.4 + rng.random() * 0.008, -122.7 + rng.random() * 0.008) for i in range(80)]
    nodes = spark.createDataFrame([(*n, math.floor(n[1] * geo.CELLS_PER_DEGREE), math.floor(n[2] * geo.CELLS_PER_DEGREE)) for n in nodes], NODES)
    pairs = [(f"{a:03d}|{b:03d}", *rng.sample([f"{a:03d}", f"{b:03d}"], 2)) for a in range(80) for b in range(a + 1, 80)] + [("000|new", "000", "new")]
    edges = spark.createDataFrame(pairs, "key string, a_key string, b_key string")
    gaps = {r["key"] for r in spatial.gap_pairs(nodes, edges.limit(0).select("key")).collect()}
    left = {r["key"] for r in spatial.out_of_reach(edges, nodes).collect()}
    assert left == {p[0] for p in pairs} - gaps and 100 < len(gaps) < 3000


def test_updates_are_made_and_shuffled_once(spark):
    n = 3000
    k = F.explode(F.sequence(F.lit(0), F.lit(n // 30 - 1)))
    rows = spark.range(30).select(F.col("id").alias("rider_id"), k.alias("event_id")).withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("event_id") * 5000))
    idx = F.floor(F.col("event_id") / 4).cast("int")
    rows = rows.select("*", idx.alias("idx"), F.lit("left").alias("next_text"), (F.col("event_id") % 4 * 10.0).alias("to_turn_m"), (900.0 - 9 * F.col("event_id")).alias("remaining_m"), F.lit(False).alias("off_route"))
    out = navigation.announced(rows)
    plan = physical(out)
    assert plan.count(" Range (0, 30,") == 1  # not once for each step over the updates
    got = out.where("rider_id = 7").orderBy("event_id").collect()
    assert len(got) == n // 30 and [r["event_id"] for r in got if r["said"] == navigation.ARRIVED] == [97] and got[4]["said"] == "In a few yards, left" and got[98]["said"] is None
    written = [e for e in re.findall(r"^[ :+-]*Exchange hashpartitioning\((\w+)#", plan, re.M) if e == "part"]
    assert len(written) == 1  # the rows go to their block once, and stay there for what is joined


def test_a_fix_finds_its_route_by_equality(spark, tmp_path):
    for name, size in (("events", "event_id % 400 < 300"), ("customer", "c_custkey % 100 < 90")):
        spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet").where(size).write.parquet(f"{tmp_path}/{name}.parquet")
    d = str(tmp_path)
    tables = {n: fixtures.fixture(spark, d, n) for n in fixtures.needs("fx_fixes")}
    want, got = spark.sql(fixtures.FIXTURES["fx_fixes"], **tables), fixtures.fixture(spark, d, "fx_fixes")
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 5000
    plan = physical(got)
    assert "CartesianProduct" not in plan and not re.search(r"BroadcastNestedLoopJoin Build\w+, Inner", plan)  # every event with every route
    none = fixtures.fixes(tables["events"], tables["fx_route_vertices"].where("false"))
    assert none.count() == 0
