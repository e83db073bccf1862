"""Batched shortest paths over the weighted network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import cells, spatial

MAX_STRAIGHT_M = 20_000.0


def network_edges(edge_rows: DataFrame, gaps: DataFrame) -> DataFrame:
    """Directed edges of lines and of gaps (key, a_key, b_key, ct, distance, maybe name) together: src, dst, key, ct, name, distance."""
    way = F.explode(F.array(F.struct(F.col("a_key").alias("src"), F.col("b_key").alias("dst")), F.struct(F.col("b_key").alias("src"), F.col("a_key").alias("dst"))))
    name = F.col("name") if "name" in gaps.columns else F.lit("")
    both = gaps.select(way.alias("w"), "key", "ct", name.alias("name"), "distance").select("w.src", "w.dst", "key", "ct", "name", "distance")
    return edge_rows.select("src", "dst", "key", "ct", "name", "distance").unionByName(both)


def endpoints(od: DataFrame, nodes: DataFrame, roads: DataFrame) -> DataFrame:
    """od_id, profile, start_key, end_key and snap distances of pairs that a path is looked for."""
    near = geo.haversine(F.col("start_lat"), F.col("start_lng"), F.col("end_lat"), F.col("end_lng")) <= MAX_STRAIGHT_M
    ends = od.where(near)
    both = F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("start_lat").alias("lat"), F.col("start_lng").alias("lng")), F.struct(F.lit(1).alias("end"), F.col("end_lat").alias("lat"), F.col("end_lng").alias("lng"))))
    points = ends.select("od_id", both.alias("p")).select((F.col("od_id") * 2 + F.col("p.end")).alias("pid"), "p.lat", "p.lng")
    snapped = spatial.snap(points, nodes, roads).withColumn("od_id", F.floor(F.col("pid") / 2)).withColumn("end", F.col("pid") % 2)
    one = snapped.groupBy("od_id").agg(*(F.max(F.when(F.col("end") == e, F.col(c))).alias(f"{n}_{s}") for e, n in ((0, "start"), (1, "end")) for c, s in (("node_key", "key"), ("distance", "snap_m"))))
    return ends.select("od_id", "profile").join(one, "od_id").where("start_key is not null and end_key is not null and start_key <> end_key")


def guided(pairs: DataFrame, edges: DataFrame, nodes: DataFrame, graph: cells.Graph | None = None) -> DataFrame:
    """od_id, pos, edge_id, cost of each path's edges, over a graph of any size; there is no limit of search effort.

    edges: edge_id, src, dst, cost. Geometry stays in Spark and is joined by edge_id afterwards. graph: these edges and nodes, dealt before.
    """
    return cells.search(pairs, graph or cells.Graph(edges, nodes))
