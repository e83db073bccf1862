"""Live tracking as a batch: map-matching, current instruction, progress, announcements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..functions.numfmt import round_half_up, voice_distance_text

OFF_ROUTE_M, ARRIVAL_M, PASSED_M, FALLBACK_SPEED = 50.0, 30.0, 10.0, 4.17
# From where a turn is announced and said again, and how long a rider is left alone.
ANNOUNCE_M, REMIND_M, COOLDOWN_MS = 80.0, 20.0, 8000
ARRIVED = "You have arrived at your destination."
#: A rider's fixes are worked on by blocks of so many milliseconds (a week: 604,800 fixes, if there is one a second), so that no task holds a whole history. In hours, few fixes share a block.
BLOCK_MS = 604_800_000
#: Within so many degrees (longitudes by the fix's cosine) plain distances tell which segments can't be the nearest one; what reaches farther is always worked out.
FLAT_DEG = 4.0
#: The off-route banner goes so long after the last fix on the route.
BANNER_MS = 2000


def measured(vertices: DataFrame) -> DataFrame:
    """Route segments with the length before them: route_id, seg, lat1, lng1, lat2, lng2, before, length."""
    w = Window.partitionBy("route_id").orderBy("idx")
    s = vertices.select("route_id", F.col("idx").alias("seg"), F.col("lat").alias("lat1"), F.col("lng").alias("lng1"), F.lead("lat").over(w).alias("lat2"), F.lead("lng").over(w).alias("lng2")).where("lat2 is not null")
    s = s.withColumn("length", geo.haversine(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2")))
    before = F.sum("length").over(Window.partitionBy("route_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1))
    return s.withColumn("before", F.coalesce(before, F.lit(0.0)))


def routes_of(vertices: DataFrame) -> DataFrame:
    """One row for each route: its segments as a sorted array, with their middle and half their length in degrees, and its length."""
    middle = [((F.col(f"{x}1") + F.col(f"{x}2")) / 2).alias(f"mid_{x}") for x in ("lat", "lng")]
    half = F.hypot(F.col("lat2") - F.col("lat1"), F.col("lng2") - F.col("lng1")) / 2
    seg = F.struct("seg", "lat1", "lng1", "lat2", "lng2", "before", "length", *middle, half.alias("half"))
    return measured(vertices).groupBy("route_id").agg(F.array_sort(F.collect_list(seg)).alias("segments"), F.sum("length").alias("total"))


def matched(fixes: DataFrame, routes: DataFrame) -> DataFrame:
    """Fixes with off_m, along_m and the matched point: the first of the nearest segments of the fix's route.

    The nearest one is the least element of an array beside the fix, so a fix stays one row and is shuffled for the join with its route at most.
    """
    rows = _nearest(fixes.join(routes.where(F.size("segments") > 0), "route_id"))
    return rows.select(*fixes.columns, "total", "off_m", "along_m", "m.seg", F.col("m.lat").alias("matched_lat"), F.col("m.lng").alias("matched_lng"))


def placed(fixes: DataFrame) -> DataFrame:
    """off_m and along_m of rows that have their route's segments beside them, as streams do."""
    return _nearest(fixes).drop("m")


def candidates(fixes: DataFrame) -> DataFrame:
    """fixes (with __k, their cosine) with those of their segments that may be the nearest one: few, so that the exact distances of the others are not worked out.

    By plain distances in degrees a segment is no nearer than its middle less half its length, and the nearest one no farther than the nearest middle. Within FLAT_DEG of a fix such a distance U is that on
    the great circle but for a factor of 1 + U / (2 * __k) in radians at most, up or down; a tenth more and a nanodegree for rounding are beyond both.
    """
    c = F.col
    middles = F.transform("segments", lambda s: F.struct(F.hypot(c("lat") - s["mid_lat"], (c("lng") - s["mid_lng"]) * c("__k")).alias("away"), s.alias("s")))
    rows = fixes.withColumn("__middles", middles).withColumn("__bound", F.array_min(c("__middles")["away"]) * 1.1 + 1e-9)
    # __bound is named twice, as a column that is named once would be put into the lambda and worked out for each segment
    beyond = lambda x: c("__bound").isNotNull() & (x["away"] - x["s"]["half"] > c("__bound")) & (x["away"] + x["s"]["half"] < c("__k") * FLAT_DEG)
    return rows.withColumn("segments", F.filter("__middles", lambda x: ~F.coalesce(beyond(x), F.lit(False)))["s"]).drop("__middles", "__bound")


def _nearest(fixes: DataFrame) -> DataFrame:
    """m: the least of the segments by distance and number. Step by step, as what a lambda names twice is computed twice, and with the fix's cosine computed before."""
    c = F.col
    fixes = candidates(fixes.withColumn("__k", F.cos(geo.rad(c("lat")))))
    f = lambda x, *names: [x[n].alias(n) for n in names]
    at = F.transform("segments", lambda s: F.struct(s.alias("s"), ((s["lng2"] - s["lng1"]) * c("__k")).alias("dx"), (s["lat2"] - s["lat1"]).alias("dy"), ((c("lng") - s["lng1"]) * c("__k")).alias("px"), (c("lat") - s["lat1"]).alias("py")))
    at = F.transform(at, lambda x: F.struct(*f(x, "s"), (x["px"] * x["dx"] + x["py"] * x["dy"]).alias("dot"), (x["dx"] * x["dx"] + x["dy"] * x["dy"]).alias("sq")))
    at = F.transform(at, lambda x: F.struct(*f(x, "s"), geo.along(x["dot"], x["sq"]).alias("t")))
    at = F.transform(at, lambda x: F.struct(*f(x, "s", "t"), (x["s"]["lat1"] + x["t"] * (x["s"]["lat2"] - x["s"]["lat1"])).alias("lat"), (x["s"]["lng1"] + x["t"] * (x["s"]["lng2"] - x["s"]["lng1"])).alias("lng")))
    at = F.transform(at, lambda x: F.struct(*f(x, "s", "t", "lat", "lng"), geo.squared_chord(c("lat"), c("lng"), x["lat"], x["lng"], c("__k")).alias("h")))
    near = F.transform(at, lambda x: F.struct(geo.arc(x["h"]).alias("d"), x["s"]["seg"].alias("seg"), (x["s"]["before"] + x["t"] * x["s"]["length"]).alias("along"), *f(x, "lat", "lng")))
    out = fixes.withColumn("m", F.array_min(near))
    return out.withColumns({"off_m": c("m.d"), "along_m": c("m.along")}).drop("segments", "__k")


def current_instruction(along: Column, instructions: Column) -> Column:
    """Index of the last instruction of the longest prefix that has been passed. instructions: array of struct(distance, text)."""
    ok = F.transform(instructions, lambda x, i: (i == 0) | (along >= x["distance"] - PASSED_M))
    bad = F.array_position(ok, F.lit(False))
    return F.when(bad == 0, F.size(instructions) - 1).otherwise(bad - 2).cast("int")


def progress(matches: DataFrame) -> DataFrame:
    """matches (with their route's instructions, route_m and route_s) with instruction, distance to the next turn, what remains, time and off-route."""
    m = matches.withColumn("idx", current_instruction(F.col("along_m"), F.col("instructions")))
    nxt = F.get("instructions", F.col("idx") + 1)
    remaining = F.greatest(F.lit(0.0), F.col("route_m") - F.col("along_m"))
    # a route of time 0 has an infinite speed, so nothing remains; length 0 falls back
    speed = F.coalesce(F.nullif(F.try_divide(F.col("route_m"), F.col("route_s")), F.lit(0.0)), F.lit(FALLBACK_SPEED))
    m = m.withColumns({"to_turn_m": F.coalesce(F.greatest(F.lit(0.0), nxt["distance"] - F.col("along_m")), F.lit(0.0)), "remaining_m": remaining, "next_text": nxt["text"]})
    eta = F.when((F.col("route_s") == 0) & (F.col("route_m") > 0), F.lit(0).cast("long")).otherwise(round_half_up(F.col("remaining_m") / speed))
    return m.withColumns({"eta_s": eta, "off_route": F.col("off_m") > OFF_ROUTE_M})


def updates(matches: DataFrame, instructions: DataFrame, facts: DataFrame) -> DataFrame:
    """One update for each fix: instruction, distance to the next turn, what remains, time, off-route and arrival (which latches).

    instructions: route_id, instructions (array of struct(distance, text) in order). facts: route_id, distance, time.
    """
    m = progress(matches.join(instructions, "route_id").join(facts.select("route_id", F.col("distance").alias("route_m"), F.col("time").alias("route_s")), "route_id"))
    w = Window.partitionBy("rider_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    arrived = F.max((F.col("remaining_m") < ARRIVAL_M).cast("int")).over(w) == 1
    heading = F.when(~F.isnan("heading"), F.col("heading"))
    return m.select("rider_id", "event_id", "ts", "route_id", heading.alias("heading"), "idx", "next_text", "to_turn_m", "remaining_m", "eta_s", "off_route", arrived.alias("arrived"))


def millis(rows: DataFrame, name: str = "ts") -> Column:
    """Milliseconds since 1970; a time without a zone is taken as it stands, whatever the session's zone."""
    if rows.schema[name].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name})")
    return F.unix_millis(name)


def banner_intervals(rows: DataFrame) -> DataFrame:
    """rider_id, event_id (of the fix that showed it), shown_ms and hidden_ms (null: it stays) of the off-route banner.

    It is shown by a fix off the route. A fix on the route starts a timer of BANNER_MS, every further fix stops it or starts it anew; when it runs out the banner goes. So it goes after a
    fix on the route with no other within that time, and the fixes up to there hold one interval, if one of them was off the route. rows: rider_id, event_id, ts, off_route.
    """
    w = Window.partitionBy("rider_id").orderBy("ms", "event_id")
    r = rows.select("rider_id", "event_id", millis(rows).alias("ms"), "off_route").withColumn("next", F.lead("ms").over(w))
    r = r.withColumn("ends", ~F.col("off_route") & (F.col("next").isNull() | (F.col("next") >= F.col("ms") + BANNER_MS)))
    r = r.withColumn("part", F.coalesce(F.sum(F.col("ends").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = F.min(F.when(F.col("off_route"), F.struct("ms", "event_id")))
    out = r.groupBy("rider_id", "part").agg(first.alias("f"), F.max(F.when(F.col("ends"), F.col("ms") + BANNER_MS)).alias("hidden_ms")).where("f is not null")
    return out.select("rider_id", "f.event_id", F.col("f.ms").alias("shown_ms"), "hidden_ms")


def announced(rows: DataFrame) -> DataFrame:
    """rider_id, event_id, ts, idx, arrived, off_route and said: what riders hear at each fix, without a loop over their fixes.

    A turn is announced by the first fix near it (ANNOUNCE_M), and said again by fixes very near it (REMIND_M) more than COOLDOWN_MS after the last word; who has arrived
    hears that and no more. After a fix near a turn the turn announced last is its turn, so a fix announces if the last one near a turn before it was near another: a comparison of neighbours.
    Fixes near the same turn in a row are a stay; when something is said again depends on what was said before it in its stay alone, so a stay's moments are folded as an array.

    Neighbours are found within blocks of a rider's time (BLOCK_MS), and between them from one row for each block. A stay is reduced to its different milliseconds before it
    is gathered, so what a task holds grows with the time that one rider spends within REMIND_M of one turn, not with the rows. Ties of ts go by event_id, then by the other columns;
    rows without a rider are one rider's. rows: updates() or columns of it.

    rows are made and shuffled once, to their block (part: a struct, as structs of nulls are equal). Every column that is shuffled also orders a block, so all steps read the same ones and Spark
    makes them once; what a step needs besides is computed after it. What comes from other blocks is joined by part, which leaves the rows where they are.
    """
    c = F.col
    r = rows.select(F.struct("rider_id", F.floor(millis(rows) / BLOCK_MS).alias("block")).alias("part"), "event_id", "ts", "idx", "off_route", "next_text", "to_turn_m", "remaining_m")
    w = Window.partitionBy("part").orderBy("ts", "event_id", "idx", "to_turn_m", "remaining_m", "next_text", "off_route")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumns({"n": F.row_number().over(w), "come": F.count(F.when(c("remaining_m") < ARRIVAL_M, 1)).over(so_far)})
    r = r.withColumn("near", F.when((c("come") == 0) & c("next_text").isNotNull() & (c("to_turn_m") <= ANNOUNCE_M), c("idx")))
    r = r.withColumn("was", F.last("near", ignorenulls=True).over(before))
    # a stay is named by the block and number of its first fix; that of a block's first stay may lie in an earlier block
    r = r.withColumn("begun", F.max(F.when(c("near") != c("was"), c("n"))).over(so_far))

    at_near = F.when(c("near").isNotNull(), c("n"))
    b = r.groupBy("part").agg(F.max("come").alias("come"), F.min(at_near).alias("n"), F.min_by("near", at_near).alias("first"), F.max_by("near", at_near).alias("last"), F.max("begun").alias("begun"))
    past = Window.partitionBy("part.rider_id").orderBy("part.block").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumns({"gone": F.coalesce(F.max("come").over(past) > 0, F.lit(False)), "carried": F.last("last", ignorenulls=True).over(past)})
    b = b.withColumn("opens", c("first") != F.coalesce(c("carried"), F.lit(-1)))
    name = lambda n: F.struct(c("part.block").alias("block"), n.alias("n"))
    opened = F.when(c("begun").isNotNull(), name(c("begun"))).when(c("opens"), name(c("n")))
    b = b.withColumn("open", F.last(opened, ignorenulls=True).over(past))
    b = b.select("part", "gone", "opens", F.when(c("opens"), name(c("n"))).otherwise(c("open")).alias("stay"))

    r = r.join(b.where("gone or opens is not null").withColumnRenamed("part", "__part"), c("part") == c("__part"), "left").drop("__part")
    r = r.withColumn("gone", F.coalesce("gone", F.lit(False)))
    speaks = ~c("gone") & F.coalesce(c("near") != c("was"), c("near").isNotNull() & c("opens"), F.lit(False))
    r = r.withColumn("speaks", speaks).withColumn("close", ~c("gone") & c("near").isNotNull() & ~c("speaks") & (c("to_turn_m") <= REMIND_M))

    stays = r.where(c("speaks") | c("close")).select("part.rider_id", F.when(c("begun").isNotNull(), name(c("begun"))).otherwise(c("stay")).alias("stay"), millis(r).alias("ms"), F.when(c("close"), name(c("n"))).alias("at"))
    moments = stays.groupBy("rider_id", "stay", "ms").agg(F.min("at").alias("at"))
    each = moments.groupBy("rider_id", "stay").agg(F.array_sort(F.collect_list(F.struct("ms", "at"))).alias("m")).where(F.size("m") > 1)
    start = F.struct(c("m")[0]["ms"].alias("last"), F.array().cast("array<struct<block:bigint,n:int>>").alias("out"))

    def step(s, x):
        says = x["at"].isNotNull() & (x["ms"] - s["last"] > COOLDOWN_MS)
        return F.struct(F.when(says, x["ms"]).otherwise(s["last"]).alias("last"), F.when(says, F.concat(s["out"], F.array(x["at"]))).otherwise(s["out"]).alias("out"))

    again = each.select("rider_id", F.explode(F.aggregate("m", start, step, lambda s: s["out"])).alias("a"))
    # by pages of a block's numbers, so that a fix is looked for among few
    page = lambda n: (n / 1024).cast("int")
    again = again.groupBy(F.struct("rider_id", "a.block").alias("__part"), page(c("a.n")).alias("page")).agg(F.collect_list("a.n").alias("ns"))
    again = again.groupBy("__part").agg(F.map_from_entries(F.collect_list(F.struct("page", "ns"))).alias("again"))
    r = r.join(again, c("part") == c("__part"), "left")
    ends = (c("come") == 1) & (c("remaining_m") < ARRIVAL_M) & ~c("gone")
    said = F.when(ends, F.lit(ARRIVED)).when(c("speaks"), F.concat(F.lit("In "), voice_distance_text(c("to_turn_m")), F.lit(", "), c("next_text"))).when(c("close") & F.array_contains(F.try_element_at("again", page(c("n"))), c("n")), c("next_text"))
    return r.select("part.rider_id", "event_id", "ts", "idx", (c("gone") | (c("come") > 0)).alias("arrived"), "off_route", said.alias("said"))
