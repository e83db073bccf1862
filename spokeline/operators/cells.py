"""Shortest paths over a graph that is dealt to cells: inside a cell by Dijkstra, from cell to cell by rounds of joins.

Nodes are dealt to square cells, halved until none holds more than `most` nodes. A cell's edges are packed once, without those that a cheaper way
over up to four other edges of the cell makes useless. A round settles, in each cell that new labels have reached, the least costs
from these labels to its nodes, for a block of pairs after another, and sends the labels of the nodes beyond the cell's edges to their cells. So there are as many
rounds as a path crosses cells, not as it has edges, and a task holds one cell's edges and one block of labels, whatever the size of the
graph. A label that cannot lead to a cheaper path any more, by the least cost of a straight metre, goes no further.

Labels remember where their path entered the cell before and by which edge it left; from the end back these make the path's stretches, whose
edges are found by settling each stretch's cell once more.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush
from math import inf

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dims, geo
from ..storage import written

#: Side of the largest cells, and how often they may be halved: the smallest hold a few dozen of the nodes, which differ in the fourth decimal.
WIDEST_DEG, LEVELS = 0.256, 10
MAX_CELL_NODES = 32_768
#: Pairs whose labels are settled by one task in one cell.
BLOCK = 8


def named(level: int, lat: str = "lat", lng: str = "lng") -> Column:
    """The number of the cell of a level around a place: level, row and column."""
    at = [F.floor(F.col(c) * F.lit(2.0**level / WIDEST_DEG)) + F.lit(1 << 23) for c in (lat, lng)]
    return F.lit(level << 50) + at[0] * F.lit(1 << 25) + at[1]


def occupied(nodes: DataFrame, most: int = MAX_CELL_NODES) -> DataFrame:
    """widest and cells: the largest cells that hold `most` nodes at most, by the widest cell around them. Only nodes of cells that hold more are counted again at the next level."""
    left, found = nodes.select("lat", "lng"), None
    for level in range(LEVELS):
        counts = written(left.groupBy(named(0).alias("widest"), named(level).alias("cell")).agg(F.count("*").alias("n")))
        fits = counts if level == LEVELS - 1 else counts.where(F.col("n") <= most)
        found = fits if found is None else found.unionByName(fits)
        over = counts.where(F.col("n") > most).select("cell")
        if over.isEmpty():
            break
        left = left.withColumn("cell", named(level)).join(F.broadcast(over), "cell", "left_semi").select("lat", "lng")
    return written(found.groupBy("widest").agg(F.sort_array(F.collect_list("cell")).alias("cells")))


def in_cell(rows: DataFrame, cells: DataFrame, name: str = "cell", lat: str = "lat", lng: str = "lng") -> DataFrame:
    """rows with the occupied cell around a place of theirs. The table of cells has a row for thousands of nodes and goes to all tasks, so the rows stay where they are."""
    found = F.explode(F.array_intersect(F.array(*(named(level, lat, lng) for level in range(LEVELS))), F.col("cells")))  # one, as occupied cells lie beside each other
    return rows.withColumn("widest", named(0, lat, lng)).join(F.broadcast(cells), "widest").withColumn(name, found).drop("widest", "cells")


def dealt(nodes: DataFrame, most: int = MAX_CELL_NODES) -> DataFrame:
    """node_key, lat, lng and cell: the largest cell around each node that holds `most` nodes at most."""
    return in_cell(nodes.select("node_key", "lat", "lng"), occupied(nodes, most))


def with_places(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the places of both their nodes (src_lat, src_lng, dst_lat, dst_lng); those to nodes that are not there are left out."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("node_key").alias(end), *(F.col(x).alias(f"{end}_{x}") for x in ("lat", "lng"))), end)
    return edges


# -- one cell -------------------------------------------------------------------------------------
PACK = "cell long, rate double, nodes array<string>, src array<int>, dst array<int>, cost array<double>, edge array<long>, out_src array<int>, out_node array<string>, out_cell array<long>, out_lat array<double>, out_lng array<double>, out_cost array<double>, out_edge array<long>"


def packs(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """One row a cell, of arrays: its nodes in order, the useful edges inside it by their start, and those that leave it; and the least cost of a straight metre of all its edges.

    edges: with the places of their nodes, so that they are shuffled once, to the cell where they start.
    """
    both = in_cell(in_cell(edges.where("src <> dst"), cells, "cell", "src_lat", "src_lng"), cells, "to_cell", "dst_lat", "dst_lng")
    metres: Column = geo.haversine(F.col("src_lat"), F.col("src_lng"), F.col("dst_lat"), F.col("dst_lng"))
    beyond = F.col("to_cell") != F.col("cell")
    rows = both.select("edge_id", "src", "dst", "cost", "cell", F.when(metres > 0, F.col("cost") / metres).alias("rate"), *(F.when(beyond, F.col(x)).alias(y) for x, y in (("to_cell", "to_cell"), ("dst_lat", "to_lat"), ("dst_lng", "to_lng"))))

    def pack(table: pa.Table) -> pa.Table:
        cost, edge, rate = (table.column(n).to_numpy() for n in ("cost", "edge_id", "rate"))
        inner = table.column("to_cell").is_null().to_numpy()
        ends = pa.chunked_array([*table.column("src").chunks, *table.column("dst").filter(pa.array(inner)).chunks], pa.string()).combine_chunks().dictionary_encode()
        nodes = ends.dictionary.to_numpy(zero_copy_only=False)
        order = np.argsort(nodes)
        place = np.argsort(order).astype(np.int32)[ends.indices.to_numpy()]
        src, dst = place[: len(cost)], np.full(len(cost), -1, np.int32)
        dst[inner] = place[len(cost) :]
        stay = np.flatnonzero(inner)
        stay = stay[np.lexsort((edge[stay], dst[stay], src[stay]))]
        stay = stay[useful(len(nodes), src[stay], dst[stay], cost[stay])]
        leave = np.flatnonzero(~inner)
        leave = leave[pc.sort_indices(table.select(["dst", "edge_id"]).take(leave), sort_keys=[("dst", "ascending"), ("edge_id", "ascending")]).to_numpy()]
        far = [table.column(n).take(leave).combine_chunks() for n in ("dst", "to_cell", "to_lat", "to_lng")]
        least = None if np.isnan(rate).all() else np.nanmin(rate)
        whole = [pa.array(nodes[order], pa.string()), *map(pa.array, (src[stay], dst[stay], cost[stay], edge[stay], src[leave])), *far, pa.array(cost[leave]), pa.array(edge[leave])]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in whole]
        return pa.table([table.column("cell").slice(0, 1).combine_chunks(), pa.array([least], pa.float64()), *lists], names=[x.split()[0] for x in PACK.split(", ")])

    return rows.groupBy("cell").applyInArrow(pack, PACK)


def useful(n: int, src: np.ndarray, dst: np.ndarray, cost: np.ndarray, passes: int = 2) -> np.ndarray:
    """Whether no way over other edges is cheaper than an edge (sorted by src): two edges in the first pass, each of them as cheap as found in the one before."""
    begin = np.searchsorted(src, np.arange(n + 1))
    low, at = cost.astype(np.float64), np.full(n, inf)
    for _ in range(passes):
        found = low.copy()
        for u in range(n):
            lo, hi = begin[u], begin[u + 1]
            if hi - lo < 2:
                continue
            near = dst[lo:hi]
            np.minimum.at(at, near, low[lo:hi])
            size = begin[near + 1] - begin[near]
            total = int(size.sum())
            if total:
                second = np.arange(total) + np.repeat(begin[near] - np.cumsum(size) + size, size)
                np.minimum.at(at, dst[second], np.repeat(low[lo:hi], size) + low[second])
                found[lo:hi] = np.minimum(low[lo:hi], at[near])
                at[dst[second]] = inf
            at[near] = inf
        low = found
    return cost <= low


class Cell:
    """A cell's graph, from its pack."""

    def __init__(self, pack: pa.Table):
        self.nodes, self.src, dst, cost = lists(pack, "nodes", "src", "dst", "cost")
        self.place = {k: i for i, k in enumerate(self.nodes)}
        self.near: list[list[tuple[int, float, int]]] = [[] for _ in self.nodes]
        for e, (u, v, x) in enumerate(zip(self.src.tolist(), dst.tolist(), cost.tolist(), strict=True)):
            self.near[u].append((v, x, e))

    def settle(self, entries: list[tuple[int, float]], goal: int = -1, bound: float = inf) -> tuple[list[float], list[int], list[int], list[int]]:
        """Least costs from entries (node, cost), the edge that reached each node, the entry it was reached from, and the nodes in order of cost.

        Ends at the goal, or where costs come to the bound.
        """
        n = len(self.nodes)
        label, by, root, order = [inf] * n, [-1] * n, [-1] * n, []
        for v, x in entries:
            if x < label[v]:
                label[v], root[v] = x, v
        heap = [(label[v], v) for v in {v for v, _ in entries}]
        heapify(heap)
        done = bytearray(n)
        while heap:
            d, u = heappop(heap)
            if done[u]:
                continue
            if d >= bound:
                break
            done[u] = 1
            order.append(u)
            if u == goal:
                break
            r = root[u]
            for v, x, e in self.near[u]:
                x += d
                if x < label[v]:
                    label[v], by[v], root[v] = x, e, r
                    heappush(heap, (x, v))
        return label, by, root, order


def lists(table: pa.Table, *names: str) -> list[np.ndarray]:
    """Array columns of a table of one row."""
    return [table.column(n).combine_chunks().flatten().to_numpy(zero_copy_only=False) for n in names]


def straight(lat: np.ndarray, lng: np.ndarray, to_lat: np.ndarray, to_lng: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(to_lat)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(to_lng - lng) / 2) ** 2
    return geo.EARTH_M * 2 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


LABEL = "od_id long, node string, cell long, cost double, edge long, edge_src string, origin string, from_cell long, lat double, lng double"


_LABELS = pa.schema([("od_id", pa.int64()), ("node", pa.string()), ("cell", pa.int64()), ("cost", pa.float64()), ("edge", pa.int64()), ("edge_src", pa.string()), ("origin", pa.string()), ("from_cell", pa.int64()), ("lat", pa.float64()), ("lng", pa.float64())])
_HOPS = pa.schema([("od_id", pa.int64()), ("stretch", pa.int32()), ("hop", pa.int32()), ("edge_id", pa.int64())])


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema) if rows else schema.empty_table()


def _crossed(rate: float):
    """Settles the labels of one cell and one block of pairs; gives those beyond the cell, and those of goals (cell null)."""

    def work(front: pa.Table, pack: pa.Table) -> pa.Table:
        if not front.num_rows or not pack.num_rows:
            return _LABELS.empty_table()
        cell, here = Cell(pack), pack.column("cell")[0].as_py()
        out_src, out_node, out_cell, out_lat, out_lng, out_cost, out_edge = lists(pack, "out_src", "out_node", "out_cell", "out_lat", "out_lng", "out_cost", "out_edge")
        beyond, of_node = np.unique(out_node.astype(str), return_index=True)
        number = {k: i for i, k in enumerate(beyond.tolist())}
        leaving: dict[int, list[tuple[int, float, int]]] = {}
        for e, (u, v, x) in enumerate(zip(out_src.tolist(), out_node, out_cost.tolist(), strict=True)):
            leaving.setdefault(u, []).append((number[v], x, e))
        rows = []
        asked: dict[int, list[dict]] = {}
        for r in front.to_pylist():
            asked.setdefault(r["od_id"], []).append(r)
        for od, of in asked.items():
            entries = [(cell.place[r["node"]], r["cost"]) for r in of if r["node"] in cell.place]
            goal, bound = cell.place.get(of[0]["goal"], -1), inf if of[0]["bound"] is None else of[0]["bound"]
            label, _, root, order = cell.settle(entries, goal, bound)
            if goal >= 0 and order and order[-1] == goal:
                bound = label[goal]
                rows.append((od, of[0]["goal"], None, bound, None, None, cell.nodes[root[goal]], None, None, None))
            best: dict[int, tuple[float, int]] = {}
            for u in order:
                for v, x, e in leaving.get(u, ()):
                    x += label[u]
                    if x < best.get(v, (bound,))[0]:
                        best[v] = (x, e)
            if best:
                v = np.array(list(best))
                x, e = np.array([b[0] for b in best.values()]), np.array([b[1] for b in best.values()])
                left = rate * straight(out_lat[of_node[v]], out_lng[of_node[v]], of[0]["goal_lat"], of[0]["goal_lng"])
                for k in np.flatnonzero(x + left < bound).tolist():
                    u = out_src[e[k]]
                    rows.append((od, out_node[e[k]], int(out_cell[e[k]]), float(x[k]), int(out_edge[e[k]]), cell.nodes[u], cell.nodes[root[u]], here, float(out_lat[e[k]]), float(out_lng[e[k]])))
        return table_of(rows, _LABELS)

    return work


def _unpacked(front: pa.Table, pack: pa.Table) -> pa.Table:
    """Edges of stretches (od_id, stretch, node where it enters, label there, node where it ends) in one cell."""
    if not front.num_rows or not pack.num_rows:
        return _HOPS.empty_table()
    cell, edge = Cell(pack), lists(pack, "edge")[0]
    out = []
    for r in front.to_pylist():
        v, way = cell.place[r["ends"]], []
        _, by, _, _ = cell.settle([(cell.place[r["enters"]], r["label"])], v)
        while by[v] >= 0:
            way.append(int(edge[by[v]]))
            v = cell.src[by[v]]
        out += [(r["od_id"], r["stretch"], hop, e) for hop, e in enumerate(reversed(way))]
    return table_of(out, _HOPS)


# -- from cell to cell ----------------------------------------------------------------------------
def in_cells(rows: DataFrame, packed: DataFrame):
    """rows and the packs of their cells, grouped by cell and block of pairs. Small as they are, the groups take long: their number of partitions is fixed, so that none are merged.

    A cell has as many blocks as its own pairs fill, so a pack is sent once for BLOCK pairs that meet in its cell, however many pairs there are in all.
    """
    parts = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = rows.select("cell", "od_id").distinct().groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    rows = rows.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("od_id"), F.col("blocks")).cast("int")).drop("blocks")
    rows = written(rows)
    needed = packed.join(F.broadcast(rows.select("cell", F.col("block").alias("of_block")).distinct()), "cell")
    return rows.repartition(parts, "cell", "block").groupBy("cell", "block").cogroup(needed.repartition(parts, "cell", "of_block").groupBy("cell", "of_block"))


def least(labels: DataFrame) -> DataFrame:
    rest = [c for c in labels.columns if c not in ("od_id", "node", "cost")]
    return labels.groupBy("od_id", "node").agg(F.min(F.struct("cost", *rest)).alias("m")).select("od_id", "node", "m.*")


class Graph:
    """A graph dealt to cells and written: its nodes with their cells, its packs, and its least cost of a straight metre, at most that of the cheapest class: no path is cheaper than this.

    edges: edge_id, src, dst, cost, and the places of both nodes, if they are known (as with_places() gives them).
    """

    def __init__(self, edges: DataFrame, nodes: DataFrame, most: int = MAX_CELL_NODES):
        places = [f"{end}_{x}" for end in ("src", "dst") for x in ("lat", "lng")]
        if not set(places) <= set(edges.columns):
            edges = with_places(edges, nodes)
        cells = occupied(nodes, most)
        self.cell_of = written(in_cell(nodes.select("node_key", "lat", "lng"), cells))
        self.packs = written(packs(edges.select("edge_id", "src", "dst", "cost", *places), cells))
        found = self.packs.agg(F.min("rate")).first()[0]
        self.rate = min(dims.LEAST_WEIGHT, found if found is not None else dims.LEAST_WEIGHT) * (1 - 1e-9)


def search(pairs: DataFrame, graph: Graph, most_rounds: int = 10_000) -> DataFrame:
    """od_id, pos, edge_id and cost (of the whole path) of the edges of each pair's cheapest path; pairs without one are left out.

    pairs: od_id (once each), start_key, end_key. Of several cheapest paths, one. Costs are not negative. Pairs that end where they start have no edges.
    """
    start = graph.cell_of.select(F.col("node_key").alias("start_key"), "cell")
    end = graph.cell_of.select(F.col("node_key").alias("end_key"), F.col("lat").alias("goal_lat"), F.col("lng").alias("goal_lng"), F.col("cell").alias("goal_cell"))
    pairs = written(pairs.select("od_id", "start_key", "end_key").where("start_key <> end_key").join(start, "start_key").join(end, "end_key"))
    null = lambda t: F.lit(None).cast(t)
    known = front = written(pairs.select("od_id", F.col("start_key").alias("node"), "cell", F.lit(0.0).alias("cost"), null("long").alias("edge"), null("string").alias("edge_src"), null("string").alias("origin"), null("long").alias("from_cell")))
    goals = written(known.where("false"))
    goal_of = pairs.select("od_id", F.col("end_key").alias("goal"), "goal_lat", "goal_lng")
    crossed = graph.packs.drop("edge", "rate")
    for _ in range(most_rounds):
        asked = front.select("od_id", "node", "cell", "cost").join(goal_of, "od_id").join(goals.select("od_id", F.col("cost").alias("bound")), "od_id", "left")
        got = written(in_cells(asked, crossed).applyInArrow(_crossed(graph.rate), LABEL))
        goals = written(least(goals.unionByName(got.where("cell is null").drop("lat", "lng"))))
        step = least(got.where("cell is not null"))
        step = step.join(known.select("od_id", "node", F.col("cost").alias("old")), ["od_id", "node"], "left").where("old is null or cost < old").drop("old")
        # the bounds of this round stop labels that other cells sent
        far = geo.haversine(F.col("lat"), F.col("lng"), F.col("goal_lat"), F.col("goal_lng")) * F.lit(graph.rate)
        step = step.join(goals.select("od_id", F.col("cost").alias("bound")), "od_id", "left").join(goal_of, "od_id")
        front = written(step.where((F.col("bound").isNull()) | (F.col("cost") + far < F.col("bound"))).select(*known.columns))
        if front.isEmpty():
            break
        known = written(least(known.unionByName(front)).select(*known.columns))
    else:
        raise RuntimeError(f"paths did not settle in {most_rounds} rounds")
    return written(_paths(pairs, goals, known, graph))


def _paths(pairs: DataFrame, goals: DataFrame, known: DataFrame, graph: Graph) -> DataFrame:
    """Stretches from the goals back, one a round, then the edges of all of them at once."""
    entered = known.select("od_id", F.col("node").alias("enters"), F.col("cost").alias("label"), F.col("edge").alias("by_edge"), F.col("edge_src").alias("ends_before"), F.col("origin").alias("enters_before"), F.col("from_cell").alias("cell_before"))
    at = goals.select("od_id", "origin").join(pairs.select("od_id", "end_key", F.col("goal_cell").alias("cell")), "od_id").select("od_id", F.lit(0).alias("stretch"), "cell", F.col("end_key").alias("ends"), F.col("origin").alias("enters"))
    stretches = None
    while True:
        at = written(at.join(entered, ["od_id", "enters"]))
        stretches = at if stretches is None else written(stretches.unionByName(at))
        further = at.where("by_edge is not null")
        if further.isEmpty():
            break
        at = further.select("od_id", (F.col("stretch") + 1).alias("stretch"), F.col("cell_before").alias("cell"), F.col("ends_before").alias("ends"), F.col("enters_before").alias("enters"))
    inside = in_cells(stretches.select("od_id", "stretch", "cell", "enters", "label", "ends"), graph.packs.select("cell", "nodes", "src", "dst", "cost", "edge")).applyInArrow(_unpacked, "od_id long, stretch int, hop int, edge_id long")
    between = stretches.where("by_edge is not null").select("od_id", "stretch", F.lit(-1).alias("hop"), F.col("by_edge").alias("edge_id"))
    pos = F.row_number().over(Window.partitionBy("od_id").orderBy(F.desc("stretch"), "hop")) - 1  # a path's edges, not a table's
    return inside.unionByName(between).withColumn("pos", pos.cast("long")).join(goals.select("od_id", "cost"), "od_id").select("od_id", "pos", "edge_id", "cost")
