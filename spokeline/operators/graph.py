"""Network build: lines from vertices, nodes by first writer, directed edges, cell index, adjacency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims, geo
from ..functions.numfmt import to_fixed


def node_key(lat: Column, lng: Column) -> Column:
    """Nodes merge where coordinates agree to four decimals."""
    return F.concat(to_fixed(lat, 4), F.lit(","), to_fixed(lng, 4))


def edge_key(a: Column, b: Column) -> Column:
    """Both node keys in order, whatever the direction."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def lines(vertices: DataFrame, attributes: DataFrame) -> DataFrame:
    """One row for each line of two vertices or more: sid, part, coords, ends, keys, ct (upper case), name, distance, line_seq.

    vertices: sid, part, seq, lat, lng. attributes: sid, ct_raw, name. Features come in the order of sid.
    """
    coords = F.transform(F.array_sort(F.collect_list(F.struct("seq", "lat", "lng"))), lambda v: F.struct(v["lat"].alias("lat"), v["lng"].alias("lng")))
    out = vertices.groupBy("sid", "part").agg(coords.alias("coords")).where(F.size("coords") >= 2)
    first, last = F.element_at("coords", 1), F.element_at("coords", -1)
    out = out.withColumns({"a_lat": first["lat"], "a_lng": first["lng"], "b_lat": last["lat"], "b_lng": last["lng"], "distance": geo.polyline_length(F.col("coords"))})
    out = out.withColumns({"a_key": node_key(F.col("a_lat"), F.col("a_lng")), "b_key": node_key(F.col("b_lat"), F.col("b_lng"))})
    out = out.withColumn("key", edge_key(F.col("a_key"), F.col("b_key"))).withColumn("line_seq", F.struct("sid", "part"))
    return out.join(attributes.select("sid", F.upper(F.coalesce("ct_raw", F.lit(""))).alias("ct"), F.coalesce("name", F.lit("")).alias("name")), "sid")


def nodes(net: DataFrame) -> DataFrame:
    """node_key, lat, lng, cells: the first line end in feature order that has a key gives its coordinates."""
    ends = F.explode(F.array(
        F.struct(F.struct("sid", "part", F.lit(0).alias("end")).alias("at"), F.col("a_key").alias("node_key"), F.col("a_lat").alias("lat"), F.col("a_lng").alias("lng")),
        F.struct(F.struct("sid", "part", F.lit(1).alias("end")).alias("at"), F.col("b_key").alias("node_key"), F.col("b_lat").alias("lat"), F.col("b_lng").alias("lng")),
    ))
    first = net.select(ends.alias("e")).select("e.*").groupBy("node_key").agg(F.min_by(F.struct("lat", "lng"), "at").alias("p"))
    return first.select("node_key", "p.lat", "p.lng").withColumns({"cell_lat": geo.cell(F.col("lat")), "cell_lng": geo.cell(F.col("lng"))})


def edges(net: DataFrame) -> DataFrame:
    """Directed edges, parallel ones kept; loops make none. Both directions come from one scan."""
    base = net.where("a_key <> b_key")
    way = F.explode(F.array(F.lit(0), F.lit(1)))
    out = base.withColumn("dir", way)
    swap = F.col("dir") == 1
    return out.select(
        "sid", "part", "dir", F.when(swap, F.col("b_key")).otherwise(F.col("a_key")).alias("src"), F.when(swap, F.col("a_key")).otherwise(F.col("b_key")).alias("dst"),
        "key", "ct", "name", "distance", F.when(swap, F.reverse("coords")).otherwise(F.col("coords")).alias("coords"),
    )


def segments(net: DataFrame, *keep: str) -> DataFrame:
    """Consecutive vertex pairs of lines: keep, k, lat1, lng1, lat2, lng2."""
    k = F.explode(F.sequence(F.lit(1), F.size("coords") - 1))
    at = lambda i, c: F.get(F.col("coords"), i)[c]
    out = net.where(F.size("coords") >= 2).select(*keep, "coords", k.alias("k"))
    return out.select(*keep, "k", at(F.col("k") - 1, "lat").alias("lat1"), at(F.col("k") - 1, "lng").alias("lng1"), at(F.col("k"), "lat").alias("lat2"), at(F.col("k"), "lng").alias("lng2"))


def with_cells(segs: DataFrame) -> DataFrame:
    """Segments by every grid cell of their boxes."""
    cells = geo.cells_of_box(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2"))
    return segs.withColumn("c", F.explode(cells)).select("*", "c.cell_lat", "c.cell_lng").drop("c")


def edge_cells(net: DataFrame) -> DataFrame:
    """The distinct cells of each line."""
    return with_cells(segments(net.where("a_key <> b_key"), "sid", "part")).select("sid", "part", "cell_lat", "cell_lng").distinct()


def costs(edge_rows: DataFrame, overrides: DataFrame | None = None, profile: str = "safest") -> DataFrame:
    """Edges with cost: no-go edges go, preferred ones cost half a metre each and have no least cost.

    overrides: key, type. Weights are a small fixed table inside the expression, so no join is needed for them.
    """
    out = edge_rows.withColumn("cost", dims.edge_cost(F.col("distance"), F.col("ct"), profile))
    if overrides is None:
        return out
    out = out.join(overrides.select("key", F.col("type").alias("override")), "key", "left").where("override is null or override <> 'nogo'")
    return out.withColumn("cost", F.when(F.col("override") == "preferred", F.col("distance") * dims.PREFERRED_WEIGHT).otherwise(F.col("cost")))


def adjacency(edge_rows: DataFrame) -> DataFrame:
    """Out-degree, distinct neighbours and metres of each node."""
    return edge_rows.groupBy("src").agg(F.count("*").alias("degree"), F.count_distinct("dst").alias("neighbours"), F.round(F.sum("distance"), 3).alias("metres"))


def adjacency_lists(edge_rows: DataFrame) -> DataFrame:
    """src and its edges in the order of features: dst, ct, distance."""
    each = F.struct("sid", "part", "dir", "dst", "ct", "distance")
    ordered = F.array_sort(F.collect_list(each))
    return edge_rows.groupBy("src").agg(F.transform(ordered, lambda e: F.struct(e["dst"].alias("dst"), e["ct"].alias("ct"), e["distance"].alias("distance"))).alias("edges"))


def with_nodes(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """nodes and those of the points (point, lat, lng) that have none yet: the first point of a key gives its coordinates."""
    new = points.withColumn("node_key", node_key(F.col("lat"), F.col("lng"))).groupBy("node_key").agg(F.min_by(F.struct("lat", "lng"), "point").alias("p")).select("node_key", "p.lat", "p.lng")
    new = new.join(nodes.select("node_key"), "node_key", "left_anti").withColumns({"cell_lat": geo.cell(F.col("lat")), "cell_lng": geo.cell(F.col("lng"))})
    return nodes.select(*new.columns).unionByName(new)
