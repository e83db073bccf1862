"""Paths over cells against Dijkstra on graphs that are dealt to many cells."""

from __future__ import annotations

import heapq
import random

import numpy as np
import pytest

from spokeline.operators import cells


def dijkstra(raw, a):
    near = {}
    for i, (s, t, c) in enumerate(raw):
        near.setdefault(s, []).append((t, c))
    best, heap = {a: 0.0}, [(0.0, a)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > best[u]:
            continue
        for t, c in near.get(u, ()):
            if d + c < best.get(t, 1e18):
                best[t] = d + c
                heapq.heappush(heap, (d + c, t))
    return best


def random_graph(seed, side=10, far=0.03):
    """A lattice over about 10 km with missing, slow, zero-cost and long edges: paths turn back into cells that they have left."""
    rng = random.Random(seed)
    nodes = [(f"n{i}", 45.4 + i // side * 0.01, -122.7 + i % side * 0.01) for i in range(side * side)]
    raw = []
    for i in range(side * side):
        for j in (i + 1, i - 1, i + side, i - side):
            if 0 <= j < side * side and abs(i % side - j % side) <= 1 and rng.random() < 0.8:
                raw.append((f"n{i}", f"n{j}", rng.choice([0.0, 5.0, 100.0, 100.0, 700.0, 3000.0])))
        if rng.random() < far:
            raw.append((f"n{i}", f"n{rng.randrange(side * side)}", rng.uniform(100, 2000)))
    raw += [("n0", "n0", 1.0), ("n3", "gone", 1.0)]  # a loop, and an edge to a node that is not there
    return nodes, raw


@pytest.mark.parametrize("most", [8, 30, 10_000])
def test_paths_cost_what_dijkstra_finds(spark, most):
    nodes, raw = random_graph(most)
    edges = spark.createDataFrame([(i, *e) for i, e in enumerate(raw)], "edge_id long, src string, dst string, cost double")
    nd = spark.createDataFrame(nodes, "node_key string, lat double, lng double")
    rng = random.Random(1)
    wanted = [(k, f"n{rng.randrange(100)}", f"n{rng.randrange(100)}") for k in range(50)] + [(90, "n5", "n5"), (91, "n5", "nowhere"), (92, "nowhere", "n5")]
    graph = cells.Graph(edges, nd, most)
    sizes = [r["count"] for r in graph.cell_of.groupBy("cell").count().collect()]
    assert max(sizes) <= most and sum(sizes) == 100 and (len(sizes) > 10 or most > 8)
    found = cells.search(spark.createDataFrame(wanted, "od_id long, start_key string, end_key string"), graph).collect()
    got = {r["od_id"]: r["cost"] for r in found}
    want = {k: best[z] for k, a, z in wanted if a != z and z in (best := dijkstra(raw[:-1], a))}
    assert got.keys() == want.keys() and len(got) > 30
    for k, a, z in wanted:
        if k in want:
            assert abs(got[k] - want[k]) < 1e-6
            steps = sorted((r["pos"], r["edge_id"]) for r in found if r["od_id"] == k)
            chain = [raw[e] for _, e in steps]
            assert [p for p, _ in steps] == list(range(len(steps))) and chain[0][0] == a and chain[-1][1] == z
            assert all(x[1] == y[0] for x, y in zip(chain, chain[1:])) and abs(sum(c for *_, c in chain) - want[k]) < 1e-6


def test_no_pairs_and_no_edges(spark):
    nodes, raw = random_graph(3, side=4)
    nd = spark.createDataFrame(nodes, "node_key string, lat double, lng double")
    edges = spark.createDataFrame([(i, *e) for i, e in enumerate(raw)], "edge_id long, src string, dst string, cost double")
    pairs = spark.createDataFrame([(1, "n0", "n9")], "od_id long, start_key string, end_key string")
    assert cells.search(pairs.limit(0), cells.Graph(edges, nd)).count() == 0
    assert cells.search(pairs, cells.Graph(edges.limit(0), nd)).count() == 0


def test_useful_edges_keep_every_least_cost():
    rng = random.Random(5)
    for _ in range(30):
        n = 12
        raw = sorted({(a, b): rng.choice([0.0, 1.0, 2.0, 5.0]) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(60)) if a != b}.items())
        src, dst, cost = np.array([k[0] for k, _ in raw]), np.array([k[1] for k, _ in raw]), np.array([c for _, c in raw])
        kept = cells.useful(n, src, dst, cost)
        every = [(a, b, c) for (a, b), c in raw]
        some = [e for e, k in zip(every, kept, strict=True) if k]
        assert all(dijkstra(every, v) == dijkstra(some, v) for v in range(n))
        assert not all(kept) or len(raw) < 40


def test_a_pack_is_sent_once_for_the_pairs_that_meet_in_its_cell(spark):
    rows = spark.createDataFrame([(100 * cell + k, cell) for cell in range(40) for k in range(cells.BLOCK // 2)], "od_id long, cell long")
    packed = spark.createDataFrame([(cell, "x" * 100) for cell in range(50)], "cell long, arrays string")
    sent = cells.in_cells(rows, packed).applyInArrow(lambda front, pack: front.select(["cell"]).slice(0, pack.num_rows), "cell long").collect()
    assert sorted(r["cell"] for r in sent) == list(range(40))  # 160 pairs, but a cell's four are one block
    rows = spark.createDataFrame([(k, 1) for k in range(10 * cells.BLOCK)], "od_id long, cell long")
    blocks = cells.in_cells(rows, packed).applyInArrow(lambda front, pack: front.select(["cell"]).slice(0, pack.num_rows), "cell long").count()
    assert 5 < blocks <= 10


def test_edges_with_places_are_shuffled_once(spark):
    nodes, raw = random_graph(4)
    nd = spark.createDataFrame(nodes, "node_key string, lat double, lng double")
    edges = spark.createDataFrame([(i, *e) for i, e in enumerate(raw)], "edge_id long, src string, dst string, cost double")
    placed = cells.with_places(edges, nd).localCheckpoint()
    packs = cells.packs(placed, cells.occupied(nd, 8))
    rows = packs.collect()
    plan = packs._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1
    inside = sum(len(r["edge"]) for r in rows)
    assert len(rows) > 10 and sum(len(r["out_edge"]) for r in rows) + inside <= placed.where("src <> dst").count() and inside > 0
    of = {r["node_key"]: r["cell"] for r in cells.dealt(nd, 8).collect()}
    assert all(of[n] == r["cell"] for r in rows for n in r["nodes"]) and all(of[n] == z for r in rows for n, z in zip(r["out_node"], r["out_cell"], strict=True))
