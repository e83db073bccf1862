"""Routes: instructions, replies of a router, stitching, summaries, elevation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..functions.numfmt import FEET_PER_METRE, METRES_PER_MILE, distance_text, leading_number, number_or, round_half_up, to_fixed

METRES_PER_SECOND = 4.2
MILE_LEG_M = 100.0

# The texts and icon names of instructions in this module are shown as they stand.


def turn_text(d: Column) -> Column:
    """What a bearing change says; exactly 30 and 150 belong to the sharper turn."""
    return F.when(F.abs(d) < 30, "Continue").when((d >= 30) & (d < 150), "Turn right").when((d <= -30) & (d > -150), "Turn left").otherwise("Make a U-turn")


def turn_icon(text: Column) -> Column:
    return F.when(text.contains("right"), "turn-right").when(text.contains("left"), "turn-left").when(text.contains("U-turn"), "u-turn").otherwise("continue")


def direction_icon(direction: Column) -> Column:
    d = F.upper(F.coalesce(direction, F.lit("")))
    return (
        F.when(d.contains("LEFT") | (d == "TL"), "turn-left").when(d.contains("RIGHT") | (d == "TR"), "turn-right")
        .when(d.contains("STRAIGHT") | (d == "C"), "straight").when(d.contains("U-TURN") | (d == "TU"), "u-turn").otherwise("continue")
    )


def from_edges(steps: DataFrame) -> DataFrame:
    """Instructions of paths: route_id, idx, text, distance (metres before it), step_distance (of the edge before it), icon.

    steps: route_id, pos, name, distance, coords of each path edge in order.
    """
    w = Window.partitionBy("route_id").orderBy("pos")
    c = F.col("coords")
    last, second = F.element_at(c, -1), F.when(F.size(c) >= 2, F.element_at(c, F.lit(2))).otherwise(F.element_at(c, 1))
    before_last = F.when(F.size(c) >= 2, F.element_at(c, F.lit(-2))).otherwise(F.element_at(c, 1))
    s = steps.select("route_id", "pos", F.coalesce("name", F.lit("")).alias("name"), "distance", last.alias("b"), second.alias("c"), before_last.alias("a"))
    s = s.withColumns({
        "n": F.row_number().over(w), "is_last": F.lead("pos").over(w).isNull(),
        "before": F.coalesce(F.sum("distance").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "was": F.lag(F.struct("name", "distance", "a", "b")).over(w),
    })
    # step by step, so that each bearing is computed once
    was = F.col("was")
    s = s.withColumn("turned", geo.bearing(was["b"]["lat"], was["b"]["lng"], F.col("c.lat"), F.col("c.lng")) - geo.bearing(was["a"]["lat"], was["a"]["lng"], was["b"]["lat"], was["b"]["lng"]))
    s = s.withColumn("turned", geo.wrap(F.col("turned")))
    s = s.withColumn("says", turn_text(F.col("turned")))
    s = s.withColumn("turn_icon", turn_icon(F.col("says")))
    here = F.when(
        F.col("n") == 1,
        F.struct(F.when(F.col("name") != "", F.concat(F.lit("Start on "), "name")).otherwise("Start your ride").alias("text"), F.lit(0.0).alias("distance"), F.lit(0.0).alias("step_distance"), F.lit("start").alias("icon")),
    ).when(
        (F.col("name") == "") | (F.col("name") != was["name"]),
        F.struct(F.when(F.col("name") != "", F.concat("says", F.lit(" onto "), "name")).otherwise(F.col("says")).alias("text"), F.col("before").alias("distance"), was["distance"].alias("step_distance"), F.col("turn_icon").alias("icon")),
    )
    end = F.when(F.col("is_last"), F.struct(F.lit("Arrive at destination").alias("text"), (F.col("before") + F.col("distance")).alias("distance"), F.lit(0.0).alias("step_distance"), F.lit("arrive").alias("icon")))
    # what is said up to an edge, in the same order; the arrival comes after it
    speaks = (F.col("n") == 1) | (F.col("name") == "") | (F.col("name") != F.col("was.name"))
    s = s.withColumn("said_so_far", F.count_if(speaks).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    out = s.select("route_id", "said_so_far", F.posexplode(F.array(here, end)).alias("k", "i")).where("i is not null")
    return out.select("route_id", (F.col("said_so_far") - 1 + F.col("k")).alias("idx"), "i.*")


def from_messages(rows: DataFrame) -> DataFrame:
    """Instructions of router replies: reply, pos, text, distance (with the row's own), step_distance, icon, lat, lng.

    rows: reply, pos (1 is the first data row), lon and lat in millionths, direction, message, distance as texts.
    Rows without a message are left out, but the first; their length still counts.
    """
    w = Window.partitionBy("reply").orderBy("pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    blank, first = F.coalesce(F.col("message"), F.lit("")) == "", F.coalesce(F.col("pos") == 1, F.lit(False))
    here = F.when(~blank | first, F.when(blank, "Start").otherwise(F.col("message")))
    out = rows.select("reply", "pos", "direction", "lat", "lon", F.coalesce(leading_number(F.col("distance")), F.lit(0.0)).alias("step"), here.alias("says"))
    out = out.withColumns({"run": F.sum("step").over(so_far), "said": F.last("says", ignorenulls=True).over(so_far), "is_last": F.lead(F.lit(1)).over(w).isNull()})
    out = out.withColumn("total", F.max("run").over(so_far))
    one = lambda pos, text, distance, step, icon: F.struct(pos.alias("pos"), text.alias("text"), distance.alias("distance"), step.alias("step_distance"), icon.alias("icon"))
    c = F.col
    said = F.when(c("says").isNotNull(), one(c("pos"), c("says"), c("run"), c("step"), F.when(c("pos") == 1, "start").otherwise(direction_icon(c("direction")))))
    # replies whose last instruction does not arrive get one that does, at the end of the track
    low = F.lower("said")
    ends = c("is_last") & c("reply").isNotNull() & c("pos").isNotNull() & ~low.contains("arrive") & ~low.contains("destination")
    arrive = F.when(ends, one(c("pos") + 1, F.lit("Arrive at destination"), c("total"), F.lit(0.0), F.lit("arrive")))
    # both come from the one row, so that a reply's rows are shuffled once
    out = out.select("reply", "lat", "lon", F.explode(F.array(said, arrive)).alias("i")).where("i is not null")
    at = lambda x: leading_number(F.col(x)) / 1e6
    return out.select("reply", "i.*", at("lat").alias("lat"), at("lon").alias("lng"))


def basic(routes: DataFrame, key: str = "route_id") -> DataFrame:
    """Three fixed instructions for routes of two points or more. routes: key, length_text, coords."""
    total = number_or(F.col("length_text"), F.lit(0.0))
    start, end = F.element_at("coords", 1), F.element_at("coords", -1)
    one = lambda text, d, s, icon, at: F.struct(F.lit(text).alias("text"), d.alias("distance"), s.alias("step_distance"), F.lit(icon).alias("icon"), at["lat"].alias("lat"), at["lng"].alias("lng"))
    zero = F.lit(0.0)
    three = F.array(one("Start your ride", zero, zero, "start", start), one("Follow the route", total, total, "continue", end), one("Arrive at destination", total, zero, "arrive", end))
    return routes.where(F.size("coords") >= 2).select(key, F.posexplode(three).alias("idx", "i")).select(key, "idx", "i.*")


def parsed(replies: DataFrame) -> DataFrame:
    """Distance, time and climb of replies from text properties that may be missing, zero or no numbers.

    replies: route_id, coords, length_text, time_text, ascend_text.
    """
    measured = geo.polyline_length(F.col("coords"))
    distance = number_or(F.col("length_text"), measured)
    return replies.select(
        "route_id", distance.alias("distance"), number_or(F.col("time_text"), round_half_up(distance / METRES_PER_SECOND).cast("double")).alias("time"),
        number_or(F.col("ascend_text"), F.lit(0.0)).alias("ascend"), F.lit(True).alias("has_elevation"),
    )


def guided(steps: DataFrame) -> DataFrame:
    """Routes of paths: coords joined without each later edge's first vertex, length over them, time, no elevation.

    steps: route_id, pos, coords.
    """
    edges = F.array_sort(F.collect_list(F.struct("pos", "coords")))
    coords = F.flatten(F.transform(edges, lambda e, i: F.when(i == 0, e["coords"]).otherwise(F.slice(e["coords"], F.lit(2), F.greatest(F.lit(0), F.size(e["coords"]) - 1)))))
    out = steps.groupBy("route_id").agg(coords.alias("coords")).withColumn("distance", geo.polyline_length(F.col("coords")))
    return out.withColumn("time", round_half_up(F.col("distance") / METRES_PER_SECOND)).withColumn("has_elevation", F.lit(False))


def stitched(core: DataFrame) -> DataFrame:
    """Totals of routes with optional legs before and after: distance, time, climb, number of points.

    core: route_id, distance, points, and first and last (structs of distance, ascend, descend, points, or null).
    Without a first leg the start replaces the core's first vertex and its connector is not added.
    """
    leg = lambda n, c: F.coalesce(F.col(f"{n}.{c}"), F.lit(0.0))
    distance = leg("first", "distance") + F.col("distance") + leg("last", "distance")
    points = F.coalesce(F.col("first.points"), F.lit(1)) + F.greatest(F.col("points") - 1, F.lit(0)) + F.greatest(F.coalesce(F.col("last.points"), F.lit(1)) - 1, F.lit(0))
    return core.select(
        "route_id", distance.alias("distance"), round_half_up(distance / METRES_PER_SECOND).alias("time"), (leg("first", "ascend") + leg("last", "ascend")).alias("ascend"),
        (leg("first", "descend") + leg("last", "descend")).alias("descend"), points.cast("long").alias("points"), F.lit(False).alias("has_elevation"),
    )


def stitched_instructions(legs: DataFrame) -> DataFrame:
    """Instructions of stitched routes: inner starts and arrivals go, distances shift by the legs before.

    legs: route_id, leg (0 first, 1 core, 2 last), idx, text, distance, step_distance, icon, leg_distance.
    """
    has = legs.groupBy("route_id").agg(F.bool_or(F.col("leg") == 0).alias("has_first"), F.bool_or(F.col("leg") == 2).alias("has_last"))
    lengths = legs.groupBy("route_id", "leg").agg(F.max("leg_distance").alias("leg_distance"))
    shift = lengths.withColumn("shift", F.coalesce(F.sum("leg_distance").over(Window.partitionBy("route_id").orderBy("leg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("leg_distance")
    rows = legs.join(has, "route_id").join(shift, ["route_id", "leg"])
    drop = ((F.col("icon") == "arrive") & ((F.col("leg") == 0) | ((F.col("leg") == 1) & F.col("has_last")))) | ((F.col("icon") == "start") & ((F.col("leg") == 2) | ((F.col("leg") == 1) & F.col("has_first"))))
    idx = F.row_number().over(Window.partitionBy("route_id").orderBy("leg", "idx")) - 1
    return rows.where(~drop).select("route_id", idx.alias("idx"), "text", (F.col("distance") + F.col("shift")).alias("distance"), "step_distance", "icon")


def with_road_geometry(gaps: DataFrame, replies: DataFrame) -> DataFrame:
    """Gap and preference edges with the road's own line where a reply has two points or more. Both by key and coords."""
    road = replies.select("key", F.col("coords").alias("road"))
    return gaps.join(road, "key", "left").withColumn("coords", F.when((F.size("road") >= 2) & (F.col("ct").startswith("_GAP") | (F.col("ct") == "_PREF")), F.col("road")).otherwise(F.col("coords"))).drop("road")


def summary(routes: DataFrame) -> DataFrame:
    """miles, minutes and climb of a route as shown; no climb without elevation."""
    return routes.select(
        "route_id", F.concat(to_fixed(F.col("distance") / METRES_PER_MILE, 1), F.lit(" mi")).alias("miles"), F.concat(round_half_up(F.col("time") / 60).cast("string"), F.lit(" min")).alias("minutes"),
        F.when(F.col("has_elevation"), F.concat(round_half_up(F.col("ascend") * FEET_PER_METRE).cast("string"), F.lit(" ft"))).alias("climb"),
    )


def elevation_profile(vertices: DataFrame) -> DataFrame:
    """route_id, idx, x and y in [0, 1]; a flat route has range 1. vertices: route_id, idx, ele."""
    every = Window.partitionBy("route_id")
    low, high, n = F.min("ele").over(every), F.max("ele").over(every), F.count("*").over(every)
    place = F.row_number().over(Window.partitionBy("route_id").orderBy("idx")) - 1
    out = vertices.select("route_id", "idx", "ele", low.alias("low"), high.alias("high"), n.alias("n"), place.alias("place")).where("n >= 2")
    return out.select("route_id", "idx", (F.col("place") / (F.col("n") - 1)).alias("x"), ((F.col("ele") - F.col("low")) / F.coalesce(F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), F.lit(1.0))).alias("y"))


def directions(instructions: DataFrame) -> DataFrame:
    """Instructions as listed: the step's length where some way lies behind, else nothing. instructions: text, distance, step_distance."""
    return instructions.withColumn("shown", F.when(F.col("distance") > 0, distance_text(F.col("step_distance"))).otherwise(""))
