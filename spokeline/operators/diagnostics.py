"""Route diagnostics: tier mix, runs, uncovered stretches, reversals, meridian crossings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo

MERIDIAN = -122.667
GREY_M, SAMPLE_M, REVERSAL_DEG = 20.0, 100.0, 120.0


def _ordered() -> Window:
    return Window.partitionBy("route_id").orderBy("idx")


def islands(vertices: DataFrame) -> DataFrame:
    """Vertices with run, the number of their run of equal tiers. vertices: route_id, idx, lat, lng, tier."""
    w = _ordered()
    change = F.when(F.lag("tier").over(w).isNull() | (F.lag("tier").over(w) != F.col("tier")), 1).otherwise(0)
    return vertices.withColumn("change", change).withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("change")


def tier_runs(vertices: DataFrame) -> DataFrame:
    """Drawn runs: each reaches one vertex into the next; a last run of one vertex is not drawn."""
    runs = islands(vertices).groupBy("route_id", "run", "tier").agg(F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.count("*").alias("n"))
    more = F.lead("run").over(Window.partitionBy("route_id").orderBy("run")).isNotNull()
    out = runs.withColumn("points", F.col("n") + F.when(more, 1).otherwise(0)).where("points >= 2")
    return out.select("route_id", "run", "tier", "start_idx", "points")


def tier_distribution(vertices: DataFrame) -> DataFrame:
    """Vertices and share of each tier of a route, with a bar of one sign for each two per cent."""
    n = vertices.groupBy("route_id", "tier").agg(F.count("*").alias("n"))
    pct = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("route_id"))
    out = n.withColumn("pct", F.round(pct, 6))
    return out.withColumn("bar", F.repeat(F.lit("#"), F.floor(F.col("pct") / 2 + 0.5).cast("int")))


def grey_segments(vertices: DataFrame, least: float = GREY_M) -> DataFrame:
    """Runs without infrastructure longer than `least` metres: the sum of each vertex's way to the next."""
    w = _ordered()
    ahead = F.coalesce(geo.haversine(F.col("lat"), F.col("lng"), F.lead("lat").over(w), F.lead("lng").over(w)), F.lit(0.0))
    runs = islands(vertices.withColumn("ahead", ahead)).where("tier = 'none'").groupBy("route_id", "run").agg(F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.sum("ahead").alias("metres"))
    return runs.where(F.col("metres") > least).drop("run")


def crossings(vertices: DataFrame, meridian: float = MERIDIAN) -> DataFrame:
    """Steps from strictly one side of a meridian to the other, with direction."""
    was = F.lag("lng").over(_ordered())
    out = vertices.withColumn("was", was)
    east, west = (F.col("was") < meridian) & (F.col("lng") > meridian), (F.col("was") > meridian) & (F.col("lng") < meridian)
    return out.where(east | west).select("route_id", "idx", F.when(east, "eastbound").otherwise("westbound").alias("direction"))


def samples(vertices: DataFrame, every: float = SAMPLE_M) -> DataFrame:
    """Vertices sampled where the length since the last sample reaches `every`, and the last one: a fold, as each sample resets the length."""
    coords = F.array_sort(F.collect_list(F.struct("idx", "lat", "lng")))
    routes = vertices.groupBy("route_id").agg(coords.alias("c")).where(F.size("c") >= 3)
    at = lambda i: F.get(F.col("c"), i)
    start = F.struct(F.lit(0.0).alias("run"), F.array(F.lit(0)).alias("out"))

    def step(s, i):
        run = s["run"] + geo.haversine(at(i - 1)["lat"], at(i - 1)["lng"], at(i)["lat"], at(i)["lng"])
        take = (run >= every) | (i == F.size("c") - 1)
        return F.struct(F.when(take, F.lit(0.0)).otherwise(run).alias("run"), F.when(take, F.concat(s["out"], F.array(i))).otherwise(s["out"]).alias("out"))

    picked = F.aggregate(F.sequence(F.lit(1), F.size("c") - 1), start, step, lambda s: s["out"])
    return routes.select("route_id", F.posexplode(F.transform(picked, lambda i: at(i))).alias("n", "p")).select("route_id", "n", "p.idx", "p.lat", "p.lng")


def reversals(vertices: DataFrame, every: float = SAMPLE_M, sharp: float = REVERSAL_DEG) -> DataFrame:
    """Samples where the way turns by more than `sharp` degrees."""
    w = Window.partitionBy("route_id").orderBy("n")
    b = geo.bearing(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng"))
    s = samples(vertices, every).withColumn("b", b).withColumn("next_b", F.lead("b").over(w))
    d = F.abs(F.col("next_b") - F.col("b"))
    out = s.where("b is not null and next_b is not null").withColumn("turn", F.when(d > 180, 360 - d).otherwise(d))
    return out.where(F.col("turn") > sharp).select("route_id", "idx", "turn")


def run_samples(runs: DataFrame) -> DataFrame:
    """The first, middle and last vertex of each run. runs: route_id, start_idx, end_idx."""
    three = F.array("start_idx", F.floor((F.col("start_idx") + F.col("end_idx")) / 2).cast("int"), "end_idx")
    return runs.select("route_id", "start_idx", F.posexplode(three).alias("sample", "idx"))


BACK_DEG = 0.002


def passes(vertices: DataFrame, corridors: DataFrame) -> DataFrame:
    """route_id, corridor and passed: whether a vertex of the route is nearer than the corridor's radius to its point, for each pair asked for.

    vertices: route_id, idx, lat, lng; corridors: route_id, corridor, lat, lng, radius. The join is on the route, so a route meets its own corridors only, and
    the answer is combined before the shuffle; a route without vertices passes nothing.
    """
    asked = corridors.select("route_id", "corridor", F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"), "radius")
    near = F.max(F.coalesce(geo.haversine(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng")) < F.col("radius"), F.lit(False)))
    return asked.join(vertices.select("route_id", "lat", "lng"), "route_id", "left").groupBy("route_id", "corridor").agg(near.alias("passed"))


def checks(vertices: DataFrame, west_of: float, least_m: float, most_m: float, back: float = BACK_DEG) -> DataFrame:
    """One row for each route: its length, whether that lies strictly between two bounds, whether it goes back north of its start by more than
    `back` degrees, and whether it has a vertex west of a meridian. vertices: route_id, idx, lat, lng."""
    w = _ordered()
    ahead = F.coalesce(geo.haversine(F.col("lat"), F.col("lng"), F.lead("lat").over(w), F.lead("lng").over(w)), F.lit(0.0))
    v = vertices.withColumn("ahead", ahead)
    out = v.groupBy("route_id").agg(F.sum("ahead").alias("metres"), F.min_by("lat", "idx").alias("from_lat"), F.max("lat").alias("top"), F.min("lng").alias("left"))
    between = (F.col("metres") > least_m) & (F.col("metres") < most_m)
    return out.select("route_id", "metres", between.alias("in_bounds"), (F.col("top") > F.col("from_lat") + back).alias("goes_back"), (F.col("left") < west_of).alias("crosses_west"))


def edge_checks(steps: DataFrame, least_edges: int = 5) -> DataFrame:
    """One row for each path: edges, whether there are more than `least_edges`, and whether more than half of them are named. steps: od_id, name."""
    n, named = F.count("*"), F.count_if(F.length("name") > 0)
    return steps.groupBy("od_id").agg(n.alias("edges"), (n > least_edges).alias("enough"), (named * 2 > n).alias("mostly_named"))
