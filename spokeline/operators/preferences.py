"""Edge preferences: keyed rows, groups, overrides, and edges that they inject."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from .graph import edge_key, node_key
from .spatial import GAP_CELLS, GAP_M, around, within

MAX_PIECE_M = 200.0


#: Rows of a group are numbered by blocks of so many values of insert_seq, so that no task holds a whole group.
NUMBER_BLOCK = 65_536


def explode_group(drawn: DataFrame) -> DataFrame:
    """One row for each key of a drawn group: all keys, group and attributes repeat. drawn: group_id, type, all_edge_keys, insert_seq."""
    return drawn.select("group_id", "type", "insert_seq", "all_edge_keys", F.posexplode("all_edge_keys").alias("pos", "edge_key"))


def members(prefs: DataFrame) -> DataFrame:
    """group_id, pos (from 0) and edge_key of the rows of groups, in the order of insert_seq and edge_key: the lists of all keys as rows, however long.

    A row's number is that in its block of insert_seq and what the blocks before it hold.
    """
    rows = prefs.where("group_id is not null").select("group_id", "insert_seq", "edge_key", F.floor(F.col("insert_seq") / NUMBER_BLOCK).alias("block"))
    before = F.sum("n").over(Window.partitionBy("group_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = rows.groupBy("group_id", "block").agg(F.count("*").alias("n")).select("group_id", "block", F.coalesce(before, F.lit(0)).alias("before"))
    n = F.row_number().over(Window.partitionBy("group_id", "block").orderBy("insert_seq", "edge_key"))
    return rows.withColumn("n", n).join(blocks, ["group_id", "block"]).select("group_id", (F.col("before") + F.col("n") - 1).alias("pos"), "edge_key")


def unique(prefs: DataFrame) -> DataFrame:
    """The first row of each group; a row without a group is its own."""
    group = F.coalesce(F.nullif(F.col("group_id"), F.lit("")), F.col("edge_key"))
    first = prefs.groupBy(group.alias("preference")).agg(F.min_by(F.struct("edge_key", "type", "insert_seq"), F.struct("insert_seq", "edge_key")).alias("p"))
    return first.select("preference", "p.edge_key", "p.type", "p.insert_seq")


def overrides(prefs: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """key and type, the last writer wins: a row sets its own key, then all keys of its group.

    A group's keys are in all_edge_keys of its rows, or, for groups of any size, in keys (group_id, pos, edge_key). All rows of such a group set the same keys, so
    its last row alone counts, and each key is met once, not once for every row of the group.
    """
    if keys is None:
        every = F.concat(F.array("edge_key"), F.coalesce(F.col("all_edge_keys"), F.array().cast("array<string>")))
        each = prefs.select("insert_seq", "edge_key", "type", F.posexplode(every).alias("pos", "key"))
    else:
        own = prefs.select("insert_seq", "edge_key", "type", F.lit(0).cast("long").alias("pos"), F.col("edge_key").alias("key"))
        last = prefs.where("group_id is not null").groupBy("group_id").agg(F.max(F.struct("insert_seq", "edge_key", "type")).alias("l")).select("group_id", "l.*")
        each = own.unionByName(keys.select("group_id", (F.col("pos") + 1).alias("pos"), F.col("edge_key").alias("key")).join(last, "group_id").drop("group_id"))
    return each.groupBy("key").agg(F.max_by("type", F.struct("insert_seq", "edge_key", "pos")).alias("type"))


def remove_members(prefs: DataFrame, removed: DataFrame, keys: DataFrame) -> DataFrame:
    """remove() for groups whose keys are rows (group_id, edge_key) in place of lists."""
    removed = removed.select("edge_key").distinct()
    hit = prefs.where("group_id is not null").join(removed, "edge_key", "left_semi").select("group_id").distinct()
    gone = keys.join(hit, "group_id", "left_semi").select("edge_key").union(removed).distinct()
    return prefs.join(gone, "edge_key", "left_anti")


def remove(prefs: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows that stay when `removed` (edge_key) go: a row of a group takes all keys of its group with it."""
    hit = prefs.join(removed.select("edge_key").distinct(), "edge_key", "left_semi")
    cascade = F.when(F.col("group_id").isNotNull() & (F.size(F.coalesce("all_edge_keys", F.array().cast("array<string>"))) > 0), F.col("all_edge_keys")).otherwise(F.array("edge_key"))
    gone = hit.select(F.explode(cascade).alias("edge_key")).union(removed.select("edge_key")).distinct()
    return prefs.join(gone, "edge_key", "left_anti")


def pieces(lines: DataFrame, key: str = "line_id", most: float = MAX_PIECE_M) -> DataFrame:
    """Polylines cut where the length since the last cut reaches `most`, and at the end.

    The cut depends on what was cut before, so it is a fold over the array; a piece whose ends share a node is dropped.
    lines: key, coords (array of struct(lat, lng)).
    """
    at = lambda i, c: F.get(F.col("coords"), i)[c]
    steps = F.sequence(F.lit(1), F.size("coords") - 1)
    start = F.struct(F.lit(0).alias("since"), F.lit(0.0).alias("run"), F.array().cast("array<struct<from:int,to:int,metres:double>>").alias("out"))

    def step(s, i):
        run = s["run"] + geo.haversine(at(i - 1, "lat"), at(i - 1, "lng"), at(i, "lat"), at(i, "lng"))
        cut = (run >= most) | (i == F.size("coords") - 1)
        piece = F.array(F.struct(s["since"].alias("from"), i.alias("to"), run.alias("metres")))
        return F.struct(F.when(cut, i).otherwise(s["since"]).alias("since"), F.when(cut, F.lit(0.0)).otherwise(run).alias("run"), F.when(cut, F.concat(s["out"], piece)).otherwise(s["out"]).alias("out"))

    cut = lines.where(F.size("coords") >= 2).withColumn("p", F.explode(F.aggregate(steps, start, step, lambda s: s["out"])))
    cut = cut.select(key, "p.*", F.slice("coords", F.col("p.from") + 1, F.col("p.to") - F.col("p.from") + 1).alias("coords"))
    ends = cut.withColumn("a_key", node_key(F.element_at("coords", 1)["lat"], F.element_at("coords", 1)["lng"])).withColumn("b_key", node_key(F.element_at("coords", -1)["lat"], F.element_at("coords", -1)["lng"]))
    return ends.where("a_key <> b_key").withColumn("key", edge_key(F.col("a_key"), F.col("b_key"))).withColumnsRenamed({"from": "from_idx", "to": "to_idx"})


def injected(cut: DataFrame, connected: DataFrame) -> DataFrame:
    """Pieces as preference edges, where no edge connects their nodes yet; the first of several wins."""
    fresh = cut.join(connected.select("key").distinct(), "key", "left_anti")
    first = F.row_number().over(Window.partitionBy("key").orderBy("from_idx", "to_idx", "metres"))
    return fresh.withColumn("n", first).where("n = 1").drop("n").withColumn("ct", F.lit("_PREF"))


# -- replay of stored preferences -----------------------------------------------------------------
def _is_line(drawn: DataFrame) -> DataFrame:
    """Whether a stored preference is a drawn line of several pieces; the others are single edges with given ends."""
    return drawn.withColumn("is_line", F.coalesce(F.size("all_edge_keys") > 1, F.lit(False)) & (F.coalesce(F.size("coords"), F.lit(0)) > 0))


def replayed_pieces(drawn: DataFrame) -> DataFrame:
    """insert_seq, step, name, a_key, b_key, key, metres and coords of the edges that each stored preference asks for.

    drawn: insert_seq (in the order of storing), edge_key, all_edge_keys, coords, name. A preference of several keys is cut into pieces again; one of a single key
    is an edge between the nodes that its key names, if it has two points.
    """
    rows = _is_line(drawn)
    many = pieces(rows.where("is_line"), "insert_seq").join(rows.select("insert_seq", "name"), "insert_seq")
    ends = F.split("edge_key", r"\|")
    one = rows.where(~F.col("is_line") & (F.size("coords") >= 2)).withColumn("ends", ends).where("size(ends) = 2 and ends[0] <> ends[1]")
    one = one.select("insert_seq", F.lit(0).alias("step"), "name", F.col("ends")[0].alias("a_key"), F.col("ends")[1].alias("b_key"), geo.polyline_length(F.col("coords")).alias("metres"), "coords")
    one = one.withColumn("key", edge_key(F.col("a_key"), F.col("b_key")))
    return many.withColumn("step", F.col("from_idx")).select("insert_seq", "step", "name", "a_key", "b_key", "key", "metres", "coords").unionByName(one)


def _made_points(drawn: DataFrame) -> DataFrame:
    """insert_seq, step, node_key, lat, lng of the nodes that replaying asks for: both ends of each piece, and of each drawn line."""
    p = replayed_pieces(drawn)
    at = lambda i, key, step: F.struct(F.col(key).alias("node_key"), F.element_at("coords", i)["lat"].alias("lat"), F.element_at("coords", i)["lng"].alias("lng"), step.cast("int").alias("step"))
    made = p.select("insert_seq", F.explode(F.array(at(1, "a_key", F.col("step") * 2 + 1), at(-1, "b_key", F.col("step") * 2 + 2))).alias("n")).select("insert_seq", "n.*")
    return made.unionByName(line_ends(drawn).where("end = 0").select("insert_seq", "node_key", "lat", "lng", F.lit(0).alias("step")))


def line_ends(drawn: DataFrame) -> DataFrame:
    """insert_seq, end (0, 1), node_key, lat, lng of both ends of each drawn line of two points or more."""
    rows = _is_line(drawn).where("is_line and size(coords) >= 2")
    ends = rows.select("insert_seq", F.posexplode(F.array(F.element_at("coords", 1), F.element_at("coords", -1))).alias("end", "p")).select("insert_seq", "end", "p.*")
    return ends.withColumn("node_key", node_key(F.col("lat"), F.col("lng")))


def nodes_after(drawn: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes, and those that replaying makes: node_key, lat, lng, cells and made (the preference that made it, null for those that were there); the first maker gives the coordinates."""
    new = _made_points(drawn).groupBy("node_key").agg(F.min(F.struct("insert_seq", "step", "lat", "lng")).alias("m")).select("node_key", "m.lat", "m.lng", F.col("m.insert_seq").alias("made"))
    new = new.join(nodes.select("node_key"), "node_key", "left_anti").withColumns({"cell_lat": geo.cell(F.col("lat")), "cell_lng": geo.cell(F.col("lng"))})
    cols = ["node_key", "lat", "lng", "cell_lat", "cell_lng"]
    return nodes.select(*cols, F.lit(None).cast("long").alias("made")).unionByName(new.select(*cols, "made"))


def replayed(drawn: DataFrame, nodes: DataFrame, connected: DataFrame) -> DataFrame:
    """Edges that replaying stored preferences adds: key, a_key, b_key, ct, name, distance, coords (from a_key to b_key) and insert_seq.

    Replaying asks, preference after preference, for the edges of its pieces and then for plain gaps from each end of its line to all nodes within reach that
    are there by then; what finds its two nodes connected is refused. So of all that asks for a pair of nodes the first one wins, an ordered minimum over
    (preference, pieces before gaps, place), and only where nothing connected them before (connected: key). No step waits for another.
    """
    p = replayed_pieces(drawn)
    asks = p.select("key", F.struct("insert_seq", F.lit(0).alias("phase"), "step").alias("at"), F.struct("a_key", "b_key", F.lit("_PREF").alias("ct"), "name", F.col("metres").alias("distance"), "coords").alias("e"))
    ends = line_ends(drawn).withColumns({"e_cell_lat": geo.cell(F.col("lat")), "e_cell_lng": geo.cell(F.col("lng"))})
    a = around(ends, GAP_CELLS, "e_cell_lat", "e_cell_lng").select("insert_seq", "end", F.col("node_key").alias("a_key"), F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"), "e_cell_lat", "e_cell_lng", "x", "y")
    b = within(nodes_after(drawn, nodes), GAP_CELLS).select(F.col("node_key").alias("b_key"), F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng"), "cell_lat", "cell_lng", "made", "x", "y")
    near = (F.abs(F.col("cell_lat") - F.col("e_cell_lat")) <= GAP_CELLS) & (F.abs(F.col("cell_lng") - F.col("e_cell_lng")) <= GAP_CELLS)
    there = (F.col("a_key") != F.col("b_key")) & (F.col("made").isNull() | (F.col("made") <= F.col("insert_seq")))
    found = a.join(b, ["x", "y"]).where(near & there).withColumn("distance", geo.haversine(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng"))).where(F.col("distance") <= GAP_M)
    point = lambda n: F.struct(F.col(f"{n}_lat").alias("lat"), F.col(f"{n}_lng").alias("lng"))
    links = found.select(edge_key(F.col("a_key"), F.col("b_key")).alias("key"), F.struct("insert_seq", F.lit(1).alias("phase"), F.col("end").alias("step")).alias("at"), F.struct("a_key", "b_key", F.lit("_GAP").alias("ct"), F.lit("").alias("name"), "distance", F.array(point("a"), point("b")).alias("coords")).alias("e"))
    first = asks.unionByName(links).groupBy("key").agg(F.min_by(F.struct("e", "at"), "at").alias("w")).select("key", "w.e.*", F.col("w.at.insert_seq").alias("insert_seq"))
    return first.join(connected.select("key").distinct(), "key", "left_anti")


def counted(prefs: DataFrame) -> DataFrame:
    """How many preferences there are, a group as one."""
    return unique(prefs).agg(F.count("*").alias("preferences"))


def lines_by_type(drawn: DataFrame) -> DataFrame:
    """type and coords of all lines drawn for it, in the order of their rows; null where none has any. drawn: type, insert_seq, coords."""
    coords = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("insert_seq", "coords"))), lambda x: x["coords"]))
    out = drawn.where("coords is not null").groupBy("type").agg(coords.alias("coords"))
    return drawn.select("type").distinct().join(out, "type", "left").withColumn("coords", F.when(F.size("coords") > 0, F.col("coords")))


def keys_of(cut: DataFrame, key: str = "line_id") -> DataFrame:
    """line and its edge keys in order, each once: of pieces that were there before, too."""
    first = cut.groupBy(key, "key").agg(F.min("from_idx").alias("at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "key"))), lambda x: x["key"]).alias("keys"))
