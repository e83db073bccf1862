"""Spatial joins on the grid: gaps between nodes, road crossings, nearest nodes and edges.

A neighbourhood of r cells is joined on coarse cells of r cells: one side goes to the nine coarse cells around it, an
equi-join meets the other side once, and the exact cell and distance tests remain as a residual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims, geo
from ..storage import written
from .graph import edge_key, segments, with_cells

GAP_M, SNAP_M, NEAR_M = 250.0, 500.0, 50.0
GAP_CELLS, SNAP_CELLS = 3, 5


def coarse(cell: Column, r: int) -> Column:
    return F.floor(cell / r).cast("long")


def around(df: DataFrame, r: int, lat: str = "cell_lat", lng: str = "cell_lng") -> DataFrame:
    """Rows by the nine coarse cells around them (columns x, y)."""
    step = lambda c: F.explode(F.sequence(coarse(F.col(c), r) - 1, coarse(F.col(c), r) + 1))
    return df.withColumn("x", step(lat)).withColumn("y", step(lng))


def within(df: DataFrame, r: int, lat: str = "cell_lat", lng: str = "cell_lng") -> DataFrame:
    return df.withColumns({"x": coarse(F.col(lat), r), "y": coarse(F.col(lng), r)})


def road_segments(road_vertices: DataFrame) -> DataFrame:
    """Segments of roads of two vertices or more, with severity rank: road, k, highway, ends, rank."""
    coords = F.transform(F.array_sort(F.collect_list(F.struct("seq", "lat", "lng"))), lambda v: F.struct(v["lat"].alias("lat"), v["lng"].alias("lng")))
    roads = road_vertices.groupBy("road").agg(F.any_value("highway").alias("highway"), coords.alias("coords"))
    return segments(roads, "road", "highway").withColumn("rank", dims.severity_rank(F.col("highway")))


def worst_crossing(lines: DataFrame, roads: DataFrame, *key: str) -> DataFrame:
    """key and rank of the worst road segment that each line (lat1, lng1, lat2, lng2) crosses; lines without a crossing are left out.

    Road segments that lie on each other count once, by the worst of them, and are written with their cells, so that their size is known when the join is planned.
    """
    ends = ("lat1", "lng1", "lat2", "lng2")
    a = with_cells(lines.select(*key, *ends))
    b = written(with_cells(roads.groupBy(*ends).agg(F.max("rank").alias("rank"))).withColumnsRenamed({c: f"r_{c}" for c in ends}))
    c = F.col
    crosses = geo.segments_cross((c("lat1"), c("lng1")), (c("lat2"), c("lng2")), (c("r_lat1"), c("r_lng1")), (c("r_lat2"), c("r_lng2")))
    return a.join(b, ["cell_lat", "cell_lng"]).where(crosses).groupBy(*key).agg(F.max("rank").alias("rank"))


def near_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of nodes within GAP_M and GAP_CELLS: key, both node keys, metres and ends. Pairs of a node with itself are left out."""
    cols = ("node_key", "lat", "lng", "cell_lat", "cell_lng")
    a = around(left, GAP_CELLS).select(*(F.col(c).alias(f"a_{c}") for c in cols), "x", "y")
    b = within(right, GAP_CELLS).select(*(F.col(c).alias(f"b_{c}") for c in cols), "x", "y")
    return _keyed(_in_reach(a.join(b, ["x", "y"]).where(F.col("a_node_key") != F.col("b_node_key"))))


def _in_reach(pairs: DataFrame) -> DataFrame:
    near = (F.abs(F.col("a_cell_lat") - F.col("b_cell_lat")) <= GAP_CELLS) & (F.abs(F.col("a_cell_lng") - F.col("b_cell_lng")) <= GAP_CELLS)
    d = geo.haversine(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng"))
    return pairs.where(near).withColumn("distance", d).where(F.col("distance") <= GAP_M)


def _keyed(pairs: DataFrame) -> DataFrame:
    out = pairs.withColumn("key", edge_key(F.col("a_node_key"), F.col("b_node_key")))
    return out.select("key", F.col("a_node_key").alias("a_key"), F.col("b_node_key").alias("b_key"), "distance", F.col("a_lat").alias("lat1"), F.col("a_lng").alias("lng1"), F.col("b_lat").alias("lat2"), F.col("b_lng").alias("lng2"))


def gap_pairs(nodes: DataFrame, connected: DataFrame) -> DataFrame:
    """a_key < b_key, ends and metres of node pairs within reach that no edge connects. connected: key.

    What a node is connected to stands beside it as an array before the pairs are made, and only the other side goes to nine coarse cells, so no pair is shuffled.
    """
    ends = F.split("key", r"\|")
    linked = connected.select(ends[0].alias("node_key"), ends[1].alias("other")).groupBy("node_key").agg(F.collect_set("other").alias("linked"))
    cols = ("node_key", "lat", "lng", "cell_lat", "cell_lng")
    a = within(nodes.join(linked, "node_key", "left"), GAP_CELLS).select(*(F.col(c).alias(f"a_{c}") for c in cols), "linked", "x", "y")
    b = around(nodes, GAP_CELLS).select(*(F.col(c).alias(f"b_{c}") for c in cols), "x", "y")
    apart = F.col("linked").isNull() | ~F.array_contains("linked", F.col("b_node_key"))
    return _keyed(_in_reach(a.join(b, ["x", "y"]).where("a_node_key < b_node_key")).where(apart))


def out_of_reach(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (key, a_key, b_key) but those between two of the nodes that are within reach of each other: what gap_pairs() and lines connect."""
    at = lambda n: nodes.select(F.col("node_key").alias(f"{n}_of"), *(F.col(c).alias(f"{n}_{c}") for c in ("lat", "lng", "cell_lat", "cell_lng")))
    ends = edges.select("key", F.least("a_key", "b_key").alias("a_of"), F.greatest("a_key", "b_key").alias("b_of"))
    near = _in_reach(ends.join(at("a"), "a_of").join(at("b"), "b_of")).select("key")
    return edges.join(near, "key", "left_anti")


def relinked(ends: DataFrame, nodes: DataFrame, connected: DataFrame) -> DataFrame:
    """Plain gaps from the ends of drawn lines to all nodes within reach that they have no edge to; roads between do not matter.

    ends: node_key, lat, lng, cells, one row for each key. A node that is there keeps its coordinates.
    """
    cols = ("node_key", "lat", "lng", "cell_lat", "cell_lng")
    every = nodes.select(*cols).unionByName(ends.select(*cols).join(nodes.select("node_key"), "node_key", "left_anti"))
    found = near_pairs(every.join(ends.select("node_key"), "node_key", "left_semi"), every).join(connected.select("key").distinct(), "key", "left_anti")
    return found.dropDuplicates(["key"]).withColumn("ct", F.lit("_GAP"))


def gap_edges(gaps: DataFrame, roads: DataFrame) -> DataFrame:
    """Gaps with ct by the worst road that they cross. The crossings are written, so that few of them meet the gaps without a shuffle of these."""
    worst = written(worst_crossing(gaps, roads, "key"))
    ct = F.when(F.col("rank") == 2, "_GAP_MAJOR").when(F.col("rank") == 1, "_GAP_BUSY").otherwise("_GAP")
    return gaps.join(worst, "key", "left").withColumn("ct", ct).drop("rank")


def _near_nodes(points: DataFrame, nodes: DataFrame, key: str, reach: int = SNAP_CELLS) -> DataFrame:
    """Points (key, lat, lng) with every node within SNAP_M and `reach` cells: both places, cells and distance."""
    p = points.select(key, "lat", "lng").withColumns({"cell_lat": geo.cell(F.col("lat")), "cell_lng": geo.cell(F.col("lng"))})
    p = around(p, reach).select(key, F.col("lat").alias("lat1"), F.col("lng").alias("lng1"), F.col("cell_lat").alias("p_lat"), F.col("cell_lng").alias("p_lng"), "x", "y")
    n = within(nodes, reach).select("node_key", F.col("lat").alias("lat2"), F.col("lng").alias("lng2"), "cell_lat", "cell_lng", "x", "y")
    near = (F.abs(F.col("cell_lat") - F.col("p_lat")) <= reach) & (F.abs(F.col("cell_lng") - F.col("p_lng")) <= reach)
    return p.join(n, ["x", "y"]).where(near).withColumn("distance", geo.haversine(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2"))).where(F.col("distance") <= SNAP_M)


def snap(points: DataFrame, nodes: DataFrame, roads: DataFrame, key: str = "pid") -> DataFrame:
    """key, node_key, distance and safe: the nearest node, or a farther one without a major road between, if not much farther. key: once each.

    The nearest node is looked for in the nine cells around a point, and within SNAP_CELLS where none there is nearer than all beyond. Only the way to the nearest node is tested for crossings, and for points where that is blocked the ways to all nodes that are not much farther. The
    nearest is an ordered minimum, so no window and no sort is needed. Ties keep the scan order of cells.
    """
    order = F.struct("distance", "cell_lat", "cell_lng", "node_key", "lat1", "lng1", "lat2", "lng2")
    major = roads.where("rank = 2")
    nearest = lambda ways: ways.groupBy(key).agg(F.min(order).alias("a")).select(key, "a.*")
    close = written(nearest(_near_nodes(points, nodes, key, 1).where(F.col("distance") < geo.clear_metres(F.col("lat1"), 1 / geo.CELLS_PER_DEGREE))))
    first = written(close.unionByName(nearest(_near_nodes(points.join(close.select(key), key, "left_anti"), nodes, key))))
    blocked = written(worst_crossing(first, major, key).select(key).join(first.select(key, F.col("distance").alias("d")), key))
    ways = _near_nodes(points.join(blocked.select(key), key, "left_semi"), nodes, key).join(blocked, key).where(F.col("distance") <= F.greatest(F.col("d") * 2, F.col("d") + 200))
    ways = written(ways.drop("x", "y", "p_lat", "p_lng", "d"))  # read by the crossing test and by the choice
    free = ways.join(worst_crossing(ways, major, key, "node_key"), [key, "node_key"], "left_anti").groupBy(key).agg(F.min(order).alias("s"))
    both = first.join(blocked.select(key, F.lit(True).alias("is_blocked")), key, "left").join(free, key, "left")
    other = F.col("s").isNotNull()
    return both.select(key, F.when(other, F.col("s.node_key")).otherwise(F.col("node_key")).alias("node_key"), F.when(other, F.col("s.distance")).otherwise(F.col("distance")).alias("distance"), (F.col("is_blocked").isNull() | other).alias("safe"))


def near_segments(points: DataFrame, segs: DataFrame, *key: str) -> DataFrame:
    """Points (key, lat, lng) with the segments within one cell of them, and their distance d."""
    p = points.select(*key, "lat", "lng").withColumns({"p_lat": geo.cell(F.col("lat")), "p_lng": geo.cell(F.col("lng"))})
    for c in ("p_lat", "p_lng"):
        p = p.withColumn(c.replace("p_", "cell_"), F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    d = geo.segment_distance(F.col("lat"), F.col("lng"), F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2"))
    return p.join(with_cells(segs), ["cell_lat", "cell_lng"]).withColumn("d", d)


def nearest_edge(points: DataFrame, net: DataFrame, *key: str, limit: float = NEAR_M) -> DataFrame:
    """key, sid, part, ct, d of the nearest line with a known tier, closer than limit; ties keep the first line."""
    known = net.where("a_key <> b_key").withColumn("tier", dims.routing_tier(F.col("ct"))).where("tier is not null")
    hits = near_segments(points, segments(known, "sid", "part", "ct", "tier"), *key).where(F.col("d") < limit)
    best = hits.groupBy(*key).agg(F.min(F.struct("d", "sid", "part", "ct", "tier")).alias("b"))
    return best.select(*key, "b.sid", "b.part", "b.ct", "b.tier", "b.d")


def near_road(points: DataFrame, roads: DataFrame, *key: str, limit: float = NEAR_M) -> DataFrame:
    """key and the worst rank of a road within limit (inclusive)."""
    return near_segments(points, roads, *key).where(F.col("d") <= limit).groupBy(*key).agg(F.max("rank").alias("rank"))


def near_preferences(points: DataFrame, pref_segments: DataFrame, *key: str, limit: float = NEAR_M) -> DataFrame:
    """key, and whether a no-go and a preferred line is closer than limit. pref_segments: type and ends."""
    hits = near_segments(points, pref_segments, *key).where(F.col("d") < limit)
    return hits.groupBy(*key).agg(F.bool_or(F.col("type") == "nogo").alias("near_nogo"), F.bool_or(F.col("type") == "preferred").alias("near_preferred"))


def classify(points: DataFrame, net: DataFrame, roads: DataFrame, pref_segments: DataFrame, *key: str) -> DataFrame:
    """Tier of each point: no-go, preferred, the nearest line, a road beside it, or none."""
    p = near_preferences(points, pref_segments, *key)
    e = nearest_edge(points, net, *key).select(*key, "tier")
    r = near_road(points, roads, *key)
    tier = (
        F.when(F.col("near_nogo"), "avoid").when(F.col("near_preferred"), "good").when(F.col("tier").isNotNull(), F.col("tier"))
        .when(F.col("rank") == 2, "avoid").when(F.col("rank") == 1, "caution").otherwise("none")
    )
    return points.join(p, [*key], "left").join(e, [*key], "left").join(r, [*key], "left").select(*points.columns, tier.alias("tier"))
