"""Event-sourced route drawing: waypoints after adds, moves, undos and clears; lines drawn along roads, whose steps depend on the router's replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def waypoints(events: DataFrame) -> DataFrame:
    """session and waypoints after all events in order: one fold over a session's events.

    events: session, seq, op (add, move, undo, clear), idx, lat, lng.
    """
    e = F.array_sort(F.collect_list(F.struct("seq", "op", "idx", "lat", "lng")))
    empty = F.array().cast("array<struct<lat:double,lng:double>>")

    def step(s, x):
        point = F.struct(x["lat"].alias("lat"), x["lng"].alias("lng"))
        return (
            F.when(x["op"] == "add", F.concat(s, F.array(point)))
            .when(x["op"] == "move", F.transform(s, lambda p, i: F.when(i == x["idx"], point).otherwise(p)))
            .when(x["op"] == "undo", F.slice(s, F.lit(1), F.greatest(F.lit(0), F.size(s) - 1)))
            .when(x["op"] == "clear", empty).otherwise(s)
        )

    return events.groupBy("session").agg(e.alias("e")).select("session", F.aggregate("e", empty, step).alias("waypoints"))


def drawn_along_roads(events: DataFrame, roads: DataFrame) -> DataFrame:
    """session, waypoints, coords and metres of lines drawn along roads, after all events in order.

    events: session, seq, op (add, undo, clear), lat, lng. roads: recorded replies a, z (struct(lat, lng)) and coords. An added point asks for the road from the last one: without a
    reply the point is taken back; a reply of fewer than two points leaves it without a line. An undo takes the last point and draws the rest anew, which gives the
    same as never having added it, so the line is that of the waypoints which stay. A session's fold has the replies between its own points beside it. Each event is
    done before the next one; of several replies between two points the first by its coordinates counts.
    """
    c = F.col
    point = F.struct(c("lat").cast("double").alias("lat"), c("lng").cast("double").alias("lng"))
    order = F.array_sort(F.collect_list(F.struct("seq", "op", point.alias("p"))))
    sessions = events.groupBy("session").agg(order.alias("e"))
    spots = events.where("op = 'add'").select("session", point.alias("p")).distinct()
    asked = roads.groupBy("a", "z").agg(F.min("coords").alias("coords"))
    near = spots.withColumnRenamed("p", "a").join(asked, "a").join(spots.withColumnRenamed("p", "z"), ["session", "z"])
    known = near.groupBy("session").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("a", "z"), "coords"))).alias("known"))
    empty = F.array().cast("array<struct<lat:double,lng:double>>")
    rows = sessions.join(known, "session", "left")

    def reply(a, z):
        return F.try_element_at("known", F.struct(a.alias("a"), z.alias("z")))

    def step(s, x):
        fits = (F.size(s) == 0) | reply(F.element_at(s, -1), x["p"]).isNotNull()
        return (
            F.when((x["op"] == "add") & F.coalesce(fits, F.lit(False)), F.concat(s, F.array(x["p"])))
            .when(x["op"] == "undo", F.slice(s, F.lit(1), F.greatest(F.lit(0), F.size(s) - 1)))
            .when(x["op"] == "clear", empty).otherwise(s)
        )

    rows = rows.withColumn("waypoints", F.aggregate("e", empty, step))
    pairs = F.arrays_zip(F.slice("waypoints", F.lit(1), F.greatest(F.lit(0), F.size("waypoints") - 1)).alias("a"), F.slice("waypoints", F.lit(2), F.greatest(F.lit(0), F.size("waypoints") - 1)).alias("z"))
    legs = F.filter(F.transform(pairs, lambda p: reply(p["a"], p["z"])), lambda x: F.coalesce(F.size(x) >= 2, F.lit(False)))
    rows = rows.withColumn("coords", F.aggregate(legs, empty, lambda s, leg: F.when(F.size(s) == 0, leg).otherwise(F.concat(s, F.slice(leg, F.lit(2), F.size(leg))))))
    at = lambda i: F.get("coords", i)
    metres = F.aggregate(F.sequence(F.lit(1), F.size("coords") - 1), F.lit(0.0), lambda m, i: m + geo.flat_distance(at(i - 1)["lat"], at(i - 1)["lng"], at(i)["lat"], at(i)["lng"]))
    return rows.select("session", "waypoints", "coords", F.when(F.size("coords") >= 2, metres).otherwise(0.0).alias("metres"))
