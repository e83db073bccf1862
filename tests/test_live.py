"""The live stream against the batch form and against plain folding, in one batch and in many."""

from __future__ import annotations

import random
from collections import namedtuple

import pytest
from pyspark.sql import functions as F

from spokeline.operators import navigation
from spokeline.streaming import live
from spokeline.streaming import navigation as spoken

E = namedtuple("E", "rider_id event_id ms kind idx next_text to_turn_m remaining_m off_route")
T0 = 1_700_000_000_000


def fix(i, ms, off=False, remaining=500.0, kind="fix"):
    return E(1, i, T0 + ms, kind, 0, "Turn", 300.0, remaining, off)


def test_banner_timer():
    events = [fix(1, 0, True), fix(2, 1000), fix(3, 2500), fix(4, 4400, True), fix(5, 5000), fix(6, 7000), fix(7, 7500, True), fix(8, 8000)]
    state, out = live.follow(None, events)
    changes = [(o[0], o[1] - T0) for o in out if o[0] in ("shown", "hidden")]
    assert changes == [("shown", 0), ("hidden", 7000), ("shown", 7500)]  # 1000 and 2500 start the timer anew, 4400 stops it, 5000 lets it run out as 7000 comes
    assert state.hide_ms == T0 + 10_000 and live.expired(state, T0 + 9_999) == (state, [])
    later, gone = live.expired(state, T0 + 10_000)
    assert gone[0][:2] == ("hidden", T0 + 10_000) and not later.banner and live.expired(later, T0 + 8000 + live.IDLE_MS)[0] is None


def test_stop_forgets_and_late_fixes_go():
    state, out = live.follow(None, [fix(1, 0, True, 20.0), fix(2, 100, kind="stop"), fix(3, 200), fix(0, 250), fix(4, 300, kind="stop"), fix(5, 400, kind="stop")])
    assert [(o[0], o[2], o[4]) for o in out] == [("shown", 1, True), ("update", 1, True), ("stopped", 2, True), ("update", 3, False), ("update", 0, False), ("stopped", 4, False)] and state is None
    state, _ = live.follow(None, [fix(1, 5000)])
    assert live.follow(state, [fix(2, 4000)]) == (state, [])


def world(spark):
    v = [(r, k, 45.4 + 0.001 * k, -122.6 + 0.01 * r) for r in (1, 2) for k in range(12)]
    vertices = spark.createDataFrame(v, "route_id long, idx int, lat double, lng double")
    seg = navigation.measured(vertices).where("seg % 3 = 0").select("route_id", F.struct(F.col("before").alias("distance"), F.concat(F.lit("Turn "), F.col("seg").cast("string")).alias("text")).alias("i"))
    instructions = seg.groupBy("route_id").agg(F.array_sort(F.collect_list("i")).alias("instructions"))
    facts = navigation.measured(vertices).groupBy("route_id").agg(F.sum("length").alias("distance")).withColumn("time", F.col("distance") / 4)
    return navigation.routes_of(vertices), instructions, facts


def raw(seed=3):
    rng = random.Random(seed)
    rows, n = [], 0
    for rider in range(6):
        ms = rider * 100
        for k in range(40):
            ms += rng.choice([300, 900, 1500, 2000, 2600, 4000])
            n += 1
            away = 0.002 if rng.random() < 0.25 else 0.0
            rows.append((rider, n, T0 + ms, "fix", 1 + rider % 2, 45.4 + 0.011 * k / 39, -122.6 + 0.01 * (1 + rider % 2) + away, None))
    return rows


SCHEMA = "rider_id long, event_id long, ms long, kind string, route_id long, lat double, lng double, message string"


@pytest.mark.parametrize("batches", [1, 3])
def test_stream_equals_batch(spark, tmp_path, batches):
    routes, instructions, facts = world(spark)
    rows = sorted(raw(), key=lambda r: r[2])
    end = max(r[2] for r in rows)
    bad = [(1, 900, T0, "error", 1, None, None, "timed out"), (1, 901, T0, "fix", 1, float("nan"), -122.0, None), (1, 902, T0, "fix", None, 45.4, -122.0, None), (None, 903, T0, "fix", 1, 45.4, -122.0, None), (1, 904, T0, "what", 1, 45.4, -122.0, None)]
    tail = [(99, 950, end + 60_000, "fix", 1, 45.4, -122.59, None), (99, 951, end + 61_000, "fix", 777, 45.4, -122.59, None)]  # moves the watermark past all timers; a route that is not there
    size = -(-len(rows) // batches)
    for k in range(batches):
        part = rows[k * size : (k + 1) * size] + (bad if k == 0 else [])
        spark.createDataFrame(part, SCHEMA).withColumn("ts", F.timestamp_millis("ms")).drop("ms").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    spark.createDataFrame(tail, SCHEMA).withColumn("ts", F.timestamp_millis("ms")).drop("ms").coalesce(1).write.parquet(str(tmp_path / "in" / "9"))
    shape = spark.read.parquet(str(tmp_path / "in" / "0")).schema
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "*"))
    good, wrong = live.sorted_out(stream)
    name = f"followed_{batches}"
    q = live.followed(good, routes, instructions, facts).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    w = wrong.writeStream.format("memory").queryName(name + "_bad").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert sorted(r["reason"] for r in spark.table(name + "_bad").collect()) == ["no position", "no rider, number or time", "no route", "timed out", "unknown kind"]

    fixes = spark.createDataFrame(rows, SCHEMA).withColumns({"ts": F.timestamp_millis("ms"), "heading": F.lit(None).cast("double")}).drop("ms", "kind", "message")
    updates = navigation.updates(navigation.matched(fixes, routes), instructions, facts).cache()
    got = [r for r in spark.table(name).collect() if r["rider_id"] != 99]
    said = {(r["event_id"], r["idx"], r["arrived"], r["off_route"], r["said"]) for r in got if r["kind"] == "update"}
    assert said == {(r["event_id"], r["idx"], r["arrived"], r["off_route"], r["said"]) for r in spoken.replay(updates).collect()} and len(said) == 240
    want = [tuple(r) for r in navigation.banner_intervals(updates).collect()]
    assert sorted((r["rider_id"], r["event_id"], r["ms"]) for r in got if r["kind"] == "shown") == sorted(x[:3] for x in want)
    assert sorted((r["rider_id"], r["ms"]) for r in got if r["kind"] == "hidden") == sorted((x[0], x[3]) for x in want if x[3] is not None)
    assert len(want) > 20
