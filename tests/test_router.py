"""Dispatch by profile, requests over many waypoints, and lines drawn along roads."""

from __future__ import annotations

from pyspark.sql import functions as F

from spokeline.operators import builder, guided

REPLY = "profile string, lonlats string, coords array<struct<lat:double,lng:double>>, ele array<double>, length_text string, time_text string, ascend_text string, descend_text string"


def test_profiles_are_dispatched(spark):
    od = spark.createDataFrame(
        [(1, "safest", 45.0, -122.0, 45.01, -122.0), (2, "balanced", 45.0, -122.0, 45.01, -122.0), (3, "balanced", 45.5, -122.0, 45.6, -122.0), (4, None, 45.0, -122.0, 45.01, -122.0), (5, "own", 45.0, -122.0, 45.01, -122.0)],
        "od_id long, profile string, start_lat double, start_lng double, end_lat double, end_lng double",
    )
    line = [(45.0, -122.0), (45.01, -122.0)]
    steps = spark.createDataFrame([(i, 0, "NG", "A", 1111.0, line) for i in (1, 2)], "od_id long, pos long, ct string, name string, distance double, coords array<struct<lat:double,lng:double>>")
    pairs = od.where("od_id <= 2").drop("profile").withColumns({"start_snap_m": F.lit(1.0), "end_snap_m": F.lit(1.0), "start_node_lat": F.lit(45.0), "start_node_lng": F.lit(-122.0), "end_node_lat": F.lit(45.01), "end_node_lng": F.lit(-122.0)})
    ask = "-122,45|-122,45.01"
    replies = spark.createDataFrame([(p, ask, line, [1.0, 2.0], t, None, "5", "") for p, t in (("safety", "10"), ("low-traffic", "20"), ("own", "30"))], REPLY)
    whole, said = guided.dispatched(od, pairs, steps, replies)
    got = {r["od_id"]: (r["profile"], r["route_source"], round(r["distance"])) for r in whole.collect()}
    assert got == {1: ("safest", "network", 1112), 2: ("balanced", "router", 20), 4: ("safest", "router", 10), 5: ("own", "router", 30)}  # nobody answers 3; 2 has a path, which is not asked for
    assert {r["od_id"] for r in said.collect()} == set(got)


def test_waypoint_lists(spark):
    asks = spark.createDataFrame(
        [(1, "safest", [(1.0, 2.0), (3.0, 4.5), (5.0, 6.0)]), (2, "safest", [(1.0, 2.0)]), (3, "safest", []), (4, "safest", None), (5, "balanced", [(1.0, 2.0), (3.0, 4.5)]), (6, "safest", [(1.0, 2.0), (3.0, 4.5)])],
        "request_id long, profile string, waypoints array<struct<lat:double,lng:double>>",
    )
    line = [(1.0, 2.0), (3.0, 4.5)]
    replies = spark.createDataFrame([("safety", "2,1|4.5,3|6,5", [*line, (5.0, 6.0)], [], "77", None, "", ""), ("low-traffic", "2,1|4.5,3", line, [], "8", None, "", "")], REPLY)
    got = {r["request_id"]: (r["status"], r["distance"]) for r in guided.over_waypoints(asks, replies).collect()}
    assert got == {1: ("answered", 77.0), 2: ("rejected", None), 3: ("rejected", None), 4: ("rejected", None), 5: ("answered", 8.0), 6: ("unanswered", None)}


def test_drawing_takes_failed_and_undone_points_back(spark):
    p = {k: (45.0 + i * 0.01, -122.0) for i, k in enumerate("abcd")}
    ops = [("add", "a"), ("add", "b"), ("add", "c"), ("add", "d"), ("undo", None), ("add", "d"), ("undo", None), ("undo", None), ("undo", None)]  # b-c has no road; c goes, b-d has one
    rows = [("all", i, o, *(p[k] if k else (None, None))) for i, (o, k) in enumerate(ops)]
    rows += [("six", i, o, *(p[k] if k else (None, None))) for i, (o, k) in enumerate(ops[:6])]
    rows += [("short", 0, "add", *p["a"]), ("short", 1, "add", *p["c"]), ("none", 0, "undo", None, None), ("gone", 0, "add", *p["a"]), ("gone", 1, "clear", None, None), ("lone", 0, "add", 1.0, 1.0), ("lone", 1, "add", 2.0, 2.0)]
    mid = (45.005, -122.001)
    roads = [(p["a"], p["b"], [p["a"], mid, p["b"]]), (p["b"], p["d"], [p["b"], p["d"]]), (p["a"], p["c"], [p["a"]])]
    kind = "struct<lat:double,lng:double>"
    out = builder.drawn_along_roads(spark.createDataFrame(rows, "session string, seq long, op string, lat double, lng double"), spark.createDataFrame(roads, f"a {kind}, z {kind}, coords array<{kind}>"))
    got = {r["session"]: ([tuple(w) for w in r["waypoints"]], [tuple(x) for x in r["coords"]], r["metres"]) for r in out.collect()}
    assert got["six"][0] == [p["a"], p["b"], p["d"]] and got["six"][1] == [p["a"], mid, p["b"], p["d"]] and 2000 < got["six"][2] < 3600
    assert got["all"] == ([], [], 0.0) or got["all"][0] == [p["a"]][: len(got["all"][0])]
    assert got["short"] == ([p["a"], p["c"]], [], 0.0) and got["none"] == ([], [], 0.0) and got["gone"] == ([], [], 0.0) and got["lone"] == ([(1.0, 1.0)], [], 0.0)
