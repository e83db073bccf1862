"""Guided routes end to end: a path through the network, roads for its gaps, legs to and from it, or a router's reply.

The router is a table of recorded replies by request: lonlats (text) and profile, with coords (array of struct lat, lng), ele, and
length_text, time_text, ascend_text and descend_text as the router gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims, geo
from ..functions.numfmt import number_or, round_half_up
from . import routes

#: A snap farther than this asks the router for a leg.
LEG_M = 100.0
ROUTER_PROFILE, ROAD_PROFILE = "safety", "shortest"
#: Profiles that users choose, and what the router is asked for; only the first is guided by the network.
GUIDED_PROFILE = "safest"
ROUTE_PROFILES = {GUIDED_PROFILE: ROUTER_PROFILE, "balanced": "low-traffic"}


def lonlats(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """A request's text; whole numbers are written without a fraction."""
    said = [F.regexp_replace(x.cast("string"), r"\.0\z", "") for x in (lng1, lat1, lng2, lat2)]
    return F.concat(said[0], F.lit(","), said[1], F.lit("|"), said[2], F.lit(","), said[3])


def lonlats_of(points: Column) -> Column:
    """The text of a request over any number of points (array of struct(lat, lng))."""
    return F.array_join(F.transform(points, lambda p: F.concat_ws(",", *(F.regexp_replace(p[x].cast("string"), r"\.0\z", "") for x in ("lng", "lat")))), "|")


def answered(requests: DataFrame, replies: DataFrame, profile: str | None = ROUTER_PROFILE) -> DataFrame:
    """Requests (with lonlats) that the router answered: coords, ele, distance, time, ascend, descend; those it did not are left out.

    profile: the one asked for; None: that of each request (column profile).
    """
    got = requests.join(replies, ["lonlats", "profile"]) if profile is None else requests.join(replies.where(F.col("profile") == profile).drop("profile"), "lonlats")
    got = got.withColumn("distance", number_or(F.col("length_text"), geo.polyline_length(F.col("coords"))))
    zero = F.lit(0.0)
    return got.withColumns({
        "time": number_or(F.col("time_text"), round_half_up(F.col("distance") / routes.METRES_PER_SECOND).cast("double")),
        "ascend": number_or(F.col("ascend_text"), zero), "descend": number_or(F.col("descend_text"), zero),
    }).drop("lonlats", "length_text", "time_text", "ascend_text", "descend_text")


def on_roads(steps: DataFrame, replies: DataFrame) -> DataFrame:
    """Path steps (ct, coords) with the road's own line in place of gaps and drawn preferences, where the router has one of two points or more."""
    a, z = F.element_at("coords", 1), F.element_at("coords", -1)
    asks = F.col("ct").startswith("_GAP") | (F.col("ct") == "_PREF")
    asked = steps.withColumn("lonlats", F.when(asks, lonlats(a["lat"], a["lng"], z["lat"], z["lng"])))
    road = replies.where((F.col("profile") == ROAD_PROFILE) & (F.size("coords") >= 2)).select("lonlats", F.col("coords").alias("road"))
    return asked.join(road, "lonlats", "left").withColumn("coords", F.coalesce("road", "coords")).drop("road", "lonlats")


def leg(pairs: DataFrame, snap: str, a: tuple[str, str], z: tuple[str, str], replies: DataFrame) -> DataFrame:
    """od_id and leg (struct) of the pairs whose snap is far and whose request the router answered."""
    asked = pairs.where(F.col(snap) > LEG_M).select("od_id", lonlats(*map(F.col, (*a, *z))).alias("lonlats"))
    return answered(asked, replies).select("od_id", F.struct("coords", "ele", "distance", "ascend", "descend").alias("leg"))


def guided(od: DataFrame, pairs: DataFrame, steps: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routes of all pairs, and their instructions.

    od: od_id and both ends. pairs: od_id, ends, start_snap_m, end_snap_m and the coordinates of both nodes (start_node_lat, ...).
    steps: od_id, pos, ct, name, distance, coords of paths. Routes: od_id, route_source (network, or router where there is no path), coords, ele, distance,
    time, ascend, descend, has_elevation. Instructions: od_id, idx, text, distance, step_distance, icon.
    """
    c = F.col
    steps = on_roads(steps, replies).withColumnRenamed("od_id", "route_id")
    core = routes.guided(steps).select(c("route_id").alias("od_id"), c("coords").alias("core"), c("distance").alias("core_m"))
    first = leg(pairs, "start_snap_m", ("start_lat", "start_lng"), ("start_node_lat", "start_node_lng"), replies).withColumnRenamed("leg", "first")
    last = leg(pairs, "end_snap_m", ("end_node_lat", "end_node_lng"), ("end_lat", "end_lng"), replies).withColumnRenamed("leg", "last")
    joined = core.join(od.select("od_id", F.struct(c("start_lat").alias("lat"), c("start_lng").alias("lng")).alias("start")), "od_id").join(first, "od_id", "left").join(last, "od_id", "left")
    rest = lambda x: F.slice(x, F.lit(2), F.greatest(F.lit(0), F.size(x) - 1))  # noqa: E731  # all but the first, which stands already
    none = F.array().cast("array<double>")
    coords = F.concat(F.coalesce(c("first.coords"), F.array("start")), rest(c("core")), F.coalesce(rest(c("last.coords")), F.array().cast("array<struct<lat:double,lng:double>>")))
    ele = F.concat(F.coalesce(c("first.ele"), F.array(F.lit(0.0))), F.array_repeat(F.lit(0.0), F.size("core") - 1), F.coalesce(rest(c("last.ele")), none))
    both = lambda x: F.coalesce(c(f"first.{x}"), F.lit(0.0)) + F.coalesce(c(f"last.{x}"), F.lit(0.0))
    distance = F.coalesce(c("first.distance"), F.lit(0.0)) + c("core_m") + F.coalesce(c("last.distance"), F.lit(0.0))
    stitched = joined.select(
        "od_id", F.lit("network").alias("route_source"), coords.alias("coords"), ele.alias("ele"), distance.alias("distance"), round_half_up(distance / routes.METRES_PER_SECOND).cast("double").alias("time"),
        both("ascend").alias("ascend"), both("descend").alias("descend"), F.lit(False).alias("has_elevation"),
    )
    direct = od.join(core.select("od_id"), "od_id", "left_anti").select("od_id", lonlats(c("start_lat"), c("start_lng"), c("end_lat"), c("end_lng")).alias("lonlats"))
    direct = answered(direct, replies)
    whole = stitched.unionByName(direct.select("od_id", F.lit("router").alias("route_source"), "coords", "ele", "distance", "time", "ascend", "descend", F.lit(True).alias("has_elevation")))

    said = ("idx", "text", "distance", "step_distance", "icon")
    of_core = routes.from_edges(steps).join(core.select(c("od_id").alias("route_id"), "core_m"), "route_id")
    of_core = of_core.withColumn("distance", F.when(c("icon") == "arrive", c("core_m")).otherwise(c("distance"))).select("route_id", F.lit(1).alias("leg"), *said, c("core_m").alias("leg_distance"))

    def of_leg(rows: DataFrame, number: int) -> DataFrame:
        rows = rows.select(c("od_id").alias("route_id"), "coords", "distance", c("distance").cast("string").alias("length_text"))
        return routes.basic(rows).join(rows.select("route_id", c("distance").alias("leg_distance")), "route_id").select("route_id", F.lit(number).alias("leg"), *said, "leg_distance")

    legs = of_core.unionByName(of_leg(first.select("od_id", "first.*"), 0)).unionByName(of_leg(last.join(core.select("od_id"), "od_id", "left_semi").select("od_id", "last.*"), 2))
    instructions = routes.stitched_instructions(legs.join(core.select(c("od_id").alias("route_id")), "route_id", "left_semi")).withColumnRenamed("route_id", "od_id")
    plain = routes.basic(direct.select("od_id", "coords", c("distance").cast("string").alias("length_text")), "od_id").select("od_id", *said)
    return whole, instructions.select("od_id", *said).unionByName(plain)


def router_profile(profile: Column) -> Column:
    """What the router is asked for under a profile; names that are not known go to it as they stand."""
    return F.coalesce(dims.lookup(ROUTE_PROFILES, profile), profile)


def dispatched(od: DataFrame, pairs: DataFrame, steps: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routes and instructions of pairs by their profile: the network guides GUIDED_PROFILE (with the router where it has no path), all others are the router's under their own profile.

    od: od_id, profile and both ends; a null profile is GUIDED_PROFILE. The others as for guided(), whose columns come back with profile.
    """
    c = F.col
    od = od.withColumn("profile", F.coalesce("profile", F.lit(GUIDED_PROFILE)))
    by_network = od.where(c("profile") == GUIDED_PROFILE)
    mine = by_network.select("od_id")
    whole, said = guided(by_network.drop("profile"), pairs.join(mine, "od_id", "left_semi"), steps.join(mine, "od_id", "left_semi"), replies)
    asked = od.where(c("profile") != GUIDED_PROFILE).select("od_id", router_profile(c("profile")).alias("profile"), lonlats(c("start_lat"), c("start_lng"), c("end_lat"), c("end_lng")).alias("lonlats"))
    got = answered(asked, replies, None)
    whole = whole.unionByName(got.select("od_id", F.lit("router").alias("route_source"), "coords", "ele", "distance", "time", "ascend", "descend", F.lit(True).alias("has_elevation")))
    plain = routes.basic(got.select("od_id", "coords", c("distance").cast("string").alias("length_text")), "od_id").select(*said.columns)
    return whole.join(od.select("od_id", "profile"), "od_id"), said.unionByName(plain)


def over_waypoints(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """request_id, status, coords, distance, time, ascend, descend of routes over waypoint lists of any length.

    requests: request_id, profile, waypoints (array of struct(lat, lng)). status: rejected (null, or fewer than two waypoints), answered, or unanswered.
    """
    c = F.col
    asked = requests.select("request_id", router_profile(c("profile")).alias("profile"), F.when(F.size("waypoints") >= 2, lonlats_of(c("waypoints"))).alias("lonlats"))
    got = answered(asked.where("lonlats is not null"), replies, None).select("request_id", "coords", "distance", "time", "ascend", "descend")
    status = F.when(c("lonlats").isNull(), "rejected").when(c("coords").isNull(), "unanswered").otherwise("answered")
    return asked.join(got, "request_id", "left").select("request_id", status.alias("status"), "coords", "distance", "time", "ascend", "descend")
