"""Operators on small inputs with hand-computed results."""

from __future__ import annotations

import heapq

from pyspark.sql import functions as F

from spokeline.operators import builder, diagnostics, graph, navigation, paths, places, preferences, routes, spatial, store


def net_of(spark, rows, attributes):
    v = spark.createDataFrame(rows, "sid long, part int, seq int, lat double, lng double")
    return graph.lines(v, spark.createDataFrame(attributes, "sid long, ct_raw string, name string"))


def test_lines_loops_parallels_and_first_writer(spark):
    rows = [
        (1, 0, 0, 45.43001, -122.60001), (1, 0, 1, 45.431, -122.6),
        (2, 0, 0, 45.43002, -122.60002), (2, 0, 1, 45.431, -122.6),  # parallel to 1, other coordinates for the same node
        (3, 0, 0, 45.44, -122.6), (3, 0, 1, 45.45, -122.61), (3, 0, 2, 45.44, -122.6),  # a loop
        (4, 0, 0, 45.46, -122.6),  # one vertex
    ]
    net = net_of(spark, rows, [(1, "ng", "A"), (2, "BL", None), (3, None, ""), (4, "NG", "")]).cache()
    assert {r["sid"] for r in net.collect()} == {1, 2, 3}
    edges = graph.edges(net).collect()
    assert sorted(e["sid"] for e in edges) == [1, 1, 2, 2]
    assert {e["ct"] for e in edges} == {"NG", "BL"}
    nodes = {r["node_key"]: (r["lat"], r["lng"]) for r in graph.nodes(net).collect()}
    assert nodes["45.4300,-122.6000"] == (45.43001, -122.60001)
    assert "45.4400,-122.6000" in nodes and not any(k.startswith("45.46") for k in nodes)


def test_overrides_prune_and_raise(spark):
    rows = [(1, 0, 0, 45.43, -122.6), (1, 0, 1, 45.431, -122.6), (2, 0, 0, 45.44, -122.6), (2, 0, 1, 45.441, -122.6)]
    net = net_of(spark, rows, [(1, "MUP_P", ""), (2, "NG", "")])
    keys = {r["sid"]: r["key"] for r in net.collect()}
    over = spark.createDataFrame([(keys[1], "preferred"), (keys[2], "nogo")], "key string, type string")
    out = graph.costs(graph.edges(net), over).collect()
    assert {r["sid"] for r in out} == {1}
    assert all(abs(r["cost"] - 0.5 * r["distance"]) < 1e-9 for r in out)  # dearer than 0.15 a metre


def test_gap_severity_and_touch(spark):
    gaps = spark.createDataFrame([("g1", 45.43, -122.6, 45.431, -122.6), ("g2", 45.43, -122.61, 45.4305, -122.61)], "key string, lat1 double, lng1 double, lat2 double, lng2 double")
    roads = spatial.road_segments(spark.createDataFrame([(1, 0, "secondary", 45.4305, -122.62), (1, 1, "secondary", 45.4305, -122.59), (2, 0, "primary", 45.4307, -122.605), (2, 1, "primary", 45.4307, -122.59)], "road long, seq int, highway string, lat double, lng double"))
    got = {r["key"]: r["ct"] for r in spatial.gap_edges(gaps, roads).collect()}
    assert got == {"g1": "_GAP_MAJOR", "g2": "_GAP"}  # g2 only touches its road


def dijkstra(edges, a, z):
    heap, best = [(0.0, a)], {a: 0.0}
    while heap:
        d, u = heapq.heappop(heap)
        if u == z:
            return d
        for s, t, c in edges:
            if s == u and d + c < best.get(t, 1e18):
                best[t] = d + c
                heapq.heappush(heap, (d + c, t))
    return None


def test_paths_match_dijkstra_both_ways(spark):
    import random

    rng = random.Random(2)
    nodes = [(f"n{i}", 45.43 + i // 5 * 0.001, -122.6 + i % 5 * 0.001, 0, 0) for i in range(25)]
    raw = [(f"n{a}", f"n{b}", 120 * rng.uniform(0.2, 3)) for a in range(25) for b in (a + 1, a + 5, a - 1, a - 5) if 0 <= b < 25 and rng.random() < 0.8]
    edges = spark.createDataFrame([(i, s, t, c) for i, (s, t, c) in enumerate(raw)], "edge_id long, src string, dst string, cost double")
    nd = spark.createDataFrame(nodes, "node_key string, lat double, lng double, cell_lat long, cell_lng long")
    pairs = spark.createDataFrame([(1, "n0", "n24"), (2, "n4", "n20"), (3, "n7", "nowhere")], "od_id long, start_key string, end_key string")
    want = {k: w for k, a, z in [(1, "n0", "n24"), (2, "n4", "n20")] if (w := dijkstra(raw, a, z)) is not None}
    found = paths.guided(pairs, edges, nd).collect()
    got = {r["od_id"]: r["cost"] for r in found}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    for k in want:  # the edges are a chain of that cost
        chain = [raw[r["edge_id"]] for r in sorted((r for r in found if r["od_id"] == k), key=lambda r: r["pos"])]
        assert all(x[1] == y[0] for x, y in zip(chain, chain[1:])) and abs(sum(c for *_, c in chain) - want[k]) < 1e-6


def test_preference_groups(spark):
    p = spark.createDataFrame(
        [("a", "nogo", 1, "g", ["a", "b"]), ("b", "nogo", 2, "g", ["a", "b"]), ("c", "preferred", 3, None, None), ("a", "preferred", 4, "", None)],
        "edge_key string, type string, insert_seq long, group_id string, all_edge_keys array<string>",
    )
    assert {r["preference"] for r in preferences.unique(p).collect()} == {"g", "c", "a"}
    assert {r["key"]: r["type"] for r in preferences.overrides(p).collect()} == {"a": "preferred", "b": "nogo", "c": "preferred"}
    left = preferences.remove(p, spark.createDataFrame([("b",), ("zz",)], "edge_key string"))
    assert {r["edge_key"] for r in left.collect()} == {"c"}


def test_pieces_reset_and_keep_the_tail(spark):
    coords = [(45.43 + i * 0.001, -122.6) for i in range(6)]  # about 111 m apart
    out = preferences.pieces(spark.createDataFrame([(1, coords)], "line_id long, coords array<struct<lat:double,lng:double>>")).orderBy("from_idx").collect()
    assert [(r["from_idx"], r["to_idx"]) for r in out] == [(0, 2), (2, 4), (4, 5)]


def test_turn_boundaries(spark):
    d = spark.createDataFrame([(30.0,), (150.0,), (-30.0,), (-150.0,), (29.9,)], "d double")
    assert [r[0] for r in d.select(routes.turn_text(F.col("d"))).collect()] == ["Turn right", "Make a U-turn", "Turn left", "Make a U-turn", "Continue"]


def test_messages_skip_blank_but_add_length(spark):
    rows = [("r", 1, "-122000000", "45000000", "C", "", "10"), ("r", 2, "-122000100", "45000100", "TL", "", "20"), ("r", 3, "-122000200", "45000200", "TR", "Go", "30")]
    out = routes.from_messages(spark.createDataFrame(rows, "reply string, pos long, lon string, lat string, direction string, message string, distance string")).orderBy("pos").collect()
    assert [(r["text"], r["distance"], r["icon"]) for r in out] == [("Start", 10.0, "start"), ("Go", 60.0, "turn-right"), ("Arrive at destination", 60.0, "arrive")]


def test_stitched_instructions(spark):
    rows = [
        (1, 0, 0, "s", 0.0, 0.0, "start", 100.0), (1, 0, 1, "a", 100.0, 0.0, "arrive", 100.0),
        (1, 1, 0, "s", 0.0, 0.0, "start", 500.0), (1, 1, 1, "t", 200.0, 200.0, "turn-left", 500.0), (1, 1, 2, "a", 500.0, 0.0, "arrive", 500.0),
    ]
    out = routes.stitched_instructions(spark.createDataFrame(rows, "route_id long, leg int, idx int, text string, distance double, step_distance double, icon string, leg_distance double")).orderBy("idx").collect()
    assert [(r["icon"], r["distance"]) for r in out] == [("start", 0.0), ("turn-left", 300.0), ("arrive", 600.0)]


def test_runs_and_crossings(spark):
    rows = [(1, i, 45.4, -122.7 + 0.01 * i, t) for i, t in enumerate(["none", "none", "good", "none", "good"])]
    v = spark.createDataFrame(rows, "route_id long, idx int, lat double, lng double, tier string")
    assert [(r["tier"], r["points"]) for r in diagnostics.tier_runs(v).orderBy("start_idx").collect()] == [("none", 3), ("good", 2), ("none", 2)]
    grey = diagnostics.grey_segments(v).orderBy("start_idx").collect()
    assert [(r["start_idx"], r["end_idx"]) for r in grey] == [(0, 1), (3, 3)]
    assert [r["idx"] for r in diagnostics.crossings(v, -122.67).collect()] == []  # a vertex on the line hides it
    assert [(r["idx"], r["direction"]) for r in diagnostics.crossings(v, -122.665).collect()] == [(4, "eastbound")]


def test_reversal(spark):
    rows = [(1, 0, 45.40, -122.7), (1, 1, 45.41, -122.7), (1, 2, 45.40, -122.7)]
    out = diagnostics.reversals(spark.createDataFrame(rows, "route_id long, idx int, lat double, lng double")).collect()
    assert len(out) == 1 and abs(out[0]["turn"] - 180) < 1e-6


def test_instruction_prefix_stops_at_first_failure(spark):
    i = F.array(*(F.struct(F.lit(x).alias("distance"), F.lit("t").alias("text")) for x in (0.0, 100.0, 50.0, 400.0)))
    rows = spark.createDataFrame([(0.0,), (60.0,), (90.0,), (395.0,)], "along double").select(navigation.current_instruction(F.col("along"), i).alias("k")).collect()
    assert [r["k"] for r in rows] == [0, 0, 2, 3]


def test_places(spark):
    p = spark.createDataFrame(
        [(1, "Park", "Oak St", "12", None, "D", "C", "S"), (2, "", "Oak St", "12", "Sub", "D", "C", ""), (3, "Oak St", "Oak St", None, None, None, None, None), (4, None, None, None, None, None, None, None)],
        "place_id long, name string, street string, housenumber string, suburb string, district string, city string, state string",
    )
    got = {r["place_id"]: (r["label"], r["detail"]) for r in places.labels(p).collect()}
    assert got == {1: ("Park", "12 Oak St, D, C, S"), 2: ("12 Oak St", "Sub, C"), 3: ("Oak St", ""), 4: ("Unknown location", "")}


def test_store_and_builder(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    up = store.upsert(t, spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int"), "id")
    assert sorted(map(tuple, up.collect())) == [("a", 1), ("b", 3), ("c", 4)]
    e = [("s", 1, "add", None, 1.0, 1.0), ("s", 2, "add", None, 2.0, 2.0), ("s", 3, "move", 0, 5.0, 5.0), ("s", 4, "add", None, 3.0, 3.0), ("s", 5, "undo", None, None, None)]
    w = builder.waypoints(spark.createDataFrame(e, "session string, seq long, op string, idx int, lat double, lng double")).first()["waypoints"]
    assert [(p["lat"], p["lng"]) for p in w] == [(5.0, 5.0), (2.0, 2.0)]


def test_guided_routes_with_and_without_legs_and_paths(spark):
    from spokeline.operators import guided, routes

    from pyspark.sql import functions as F

    at = lambda *xy: [(a, b) for a, b in xy]
    od = spark.createDataFrame([(1, 45.0, -122.0, 45.01, -122.0), (2, 45.0, -122.0, 45.01, -122.0), (3, 45.5, -122.0, 45.6, -122.0), (4, 46.0, -122.0, 46.6, -122.0)], "od_id long, start_lat double, start_lng double, end_lat double, end_lng double")
    pairs = od.where("od_id < 3").withColumns({"start_snap_m": F.lit(150.0), "end_snap_m": F.when(F.col("od_id") == 1, 150.0).otherwise(100.0), "start_node_lat": F.lit(45.001), "start_node_lng": F.lit(-122.0), "end_node_lat": F.lit(45.009), "end_node_lng": F.lit(-122.0)})
    steps = spark.createDataFrame(
        [(i, 0, "NG", "A", 400.0, at((45.001, -122.0), (45.005, -122.0))) for i in (1, 2)] + [(i, 1, "_GAP", "", 400.0, at((45.005, -122.0), (45.009, -122.0))) for i in (1, 2)],
        "od_id long, pos long, ct string, name string, distance double, coords array<struct<lat:double,lng:double>>",
    )
    rows = [("safety", (45.0, -122.0, 45.001, -122.0), "120"), ("safety", (45.009, -122.0, 45.01, -122.0), "x"), ("safety", (45.5, -122.0, 45.6, -122.0), "0"), ("shortest", (45.005, -122.0, 45.009, -122.0), None)]
    replies = spark.createDataFrame([(p, *a, t) for p, a, t in rows], "profile string, a double, b double, c double, d double, length_text string")
    line = F.array(F.struct(F.col("a").alias("lat"), F.col("b").alias("lng")), F.struct((F.col("a") + 0.0005).alias("lat"), F.lit(-122.001).alias("lng")), F.struct(F.col("c").alias("lat"), F.col("d").alias("lng")))
    replies = replies.select("profile", guided.lonlats(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("lonlats"), line.alias("coords"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("ele"), "length_text", F.lit(None).cast("string").alias("time_text"), F.lit("7").alias("ascend_text"), F.lit("").alias("descend_text"))
    assert replies.first()["lonlats"] == "-122,45|-122,45.001"
    whole, said = guided.guided(od, pairs, steps, replies)
    got = {r["od_id"]: r for r in whole.collect()}
    text = {i: [r["text"] for r in sorted((r for r in said.collect() if r["od_id"] == i), key=lambda r: r["idx"])] for i in got}
    assert {i: r["route_source"] for i, r in got.items()} == {1: "network", 2: "network", 3: "router"}  # nobody answers 4
    assert len(got[1]["coords"]) == 3 + 3 + 2 and got[1]["ele"] == [1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 2.0, 3.0] and got[1]["ascend"] == 14.0
    assert len(got[2]["coords"]) == 3 + 3 and len(got[2]["ele"]) == 6 and got[2]["time"] == int(got[2]["distance"] / 4.2 + 0.5)
    assert text[1] == ["Start your ride", "Follow the route", "Turn left", "Follow the route", "Arrive at destination"] and text[2][-1] == "Arrive at destination"
    assert text[3] == ["Start your ride", "Follow the route", "Arrive at destination"] and got[3]["has_elevation"] and got[3]["distance"] > 11_000
    assert routes.METRES_PER_SECOND == 4.2


def test_route_checks_and_corridors(spark):
    rows = [(1, 0, 45.500, -122.66), (1, 1, 45.501, -122.67), (1, 2, 45.490, -122.66), (2, 0, 45.5, -122.69), (3, 0, 45.5, -122.66), (3, 1, 45.5031, -122.66)]
    v = spark.createDataFrame(rows, "route_id long, idx int, lat double, lng double")
    got = {r["route_id"]: (r["in_bounds"], r["goes_back"], r["crosses_west"]) for r in diagnostics.checks(v, -122.68, 1000.0, 5000.0).collect()}
    assert got == {1: (True, False, False), 2: (False, False, True), 3: (False, True, False)}
    asked = spark.createDataFrame([(1, "near", 45.501, -122.671, 100.0), (1, "at its radius", 45.501, -122.67, 0.0), (2, "far", 45.6, -122.6, 200.0), (9, "no such route", 45.5, -122.6, 200.0)], "route_id long, corridor string, lat double, lng double, radius double")
    assert {r["corridor"]: r["passed"] for r in diagnostics.passes(v, asked).collect()} == {"near": True, "at its radius": False, "far": False, "no such route": False}
    steps = spark.createDataFrame([(1, n) for n in ("A", "A", "", "B", "", "C")] + [(2, "A"), (2, None), (3, "")], "od_id long, name string")
    assert {tuple(r) for r in diagnostics.edge_checks(steps).collect()} == {(1, 6, True, True), (2, 2, False, False), (3, 1, False, False)}


def test_addresses_and_bias(spark):
    rows = [(1, "12", "Oak St", "Cafe", "x, y"), (2, None, "Oak St", "Cafe", "x"), (3, "12", "", "Cafe", "x"), (4, "12", None, "", "Old Town, City"), (5, None, None, None, None), (6, "", "", "", ", City")]
    p = spark.createDataFrame(rows, "place_id long, house_number string, road string, name string, display_name string")
    assert {r["place_id"]: r["label"] for r in places.address_label(p).collect()} == {1: "12 Oak St", 2: "Oak St", 3: "Cafe", 4: "Old Town", 5: None, 6: None}
    there = spark.createDataFrame([(1, "Park", 45.50, -122.6), (2, "Park", 45.52, -122.6), (3, "Parking", 45.52, -122.6), (4, "Park", None, None)], "place_id long, name string, lat double, lng double")
    q = spark.createDataFrame([(1, "park", 45.521), (2, "PARK", None)], "query_id long, text string, bias_lat double").selectExpr("*", "-122.6D bias_lng", "40D min_lat", "50D max_lat", "-130D min_lng", "-120D max_lng")
    got = sorted((r["query_id"], r["rank"], r["place_id"]) for r in places.search(q, there, there.limit(0), limit=2).collect())
    assert got == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 2)]


def test_savable(spark):
    rows = [(1, [1, 2], 5.0, " a "), (2, [1], 5.0, "a"), (3, [1, 2], None, "a"), (4, [1, 2], 5.0, "  "), (5, None, 5.0, "a"), (6, [1, 2, 3], 0.0, None)]
    out = store.savable(spark.createDataFrame(rows, "id int, waypoints array<int>, route double, name string"))
    assert [(r["id"], r["name"]) for r in out.collect()] == [(1, "a")]


def test_messages_of_a_reply_are_shuffled_once(spark):
    rows = [
        ("a", 1, "", "10m", 1), ("a", 2, "Turn", "20m", 2), ("a", 3, "", "-5m", 3),  # the track's end counts what is longest so far
        ("b", 1, "Go", "x", 4), ("b", 2, "Arrive there", "7", 5), ("c", 2, "", "3m", 6), (None, 1, "Go", "1m", 7),
    ]
    df = spark.createDataFrame(rows, "reply string, pos int, message string, distance string, k int").selectExpr("*", "'TL' as direction", "cast(k * 1000000 as string) as lat", "cast(-k * 1000000 as string) as lon")
    out = routes.from_messages(df)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r["reply"], r["pos"]): (r["text"], r["distance"], r["step_distance"], r["icon"], r["lat"], r["lng"]) for r in out.collect()}
    assert got == {
        ("a", 1): ("Start", 10.0, 10.0, "start", 1.0, -1.0), ("a", 2): ("Turn", 30.0, 20.0, "turn-left", 2.0, -2.0), ("a", 4): ("Arrive at destination", 30.0, 0.0, "arrive", 3.0, -3.0),
        ("b", 1): ("Go", 0.0, 0.0, "start", 4.0, -4.0), ("b", 2): ("Arrive there", 7.0, 7.0, "turn-left", 5.0, -5.0), (None, 1): ("Go", 1.0, 1.0, "start", 7.0, -7.0),
    }
