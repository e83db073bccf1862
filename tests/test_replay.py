"""Replay of stored preferences against doing it one after another."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from spokeline.operators import preferences


def metres(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 12742000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def node(p):
    return f"{p[0]:.4f},{p[1]:.4f}"


def one_after_another(prefs, nodes, connected):
    """A plain graph that is changed step by step."""
    nodes = dict(nodes)
    edges = {k: None for k in connected}

    def put(a, b, ct, d, seq):
        k = "|".join(sorted((a, b)))
        if k not in edges:
            edges[k] = (ct, round(d, 6), seq)

    for seq, edge_key, keys, coords in prefs:
        if keys and len(keys) > 1 and coords:
            if len(coords) < 2:
                continue
            chain, parts, part, run, at = [node(coords[0])], [], [coords[0]], 0.0, node(coords[0])
            nodes.setdefault(at, coords[0])
            for i in range(1, len(coords)):
                run += metres(coords[i - 1], coords[i])
                part.append(coords[i])
                if run >= 200 or i == len(coords) - 1:
                    z = node(coords[i])
                    nodes.setdefault(z, coords[i])
                    if z != at:
                        parts.append((at, z, run))
                        chain.append(z)
                        at = z
                    part, run = [coords[i]], 0.0
            for a, z, d in parts:
                put(a, z, "_PREF", d, seq)
            for end, p in ((chain[0], coords[0]), (chain[-1], coords[-1])):
                cell = [math.floor(x * 1000) for x in p]
                for k, n in list(nodes.items()):
                    if k != end and all(abs(math.floor(x * 1000) - y) <= 3 for x, y in zip(n, cell)) and metres(p, n) <= 250:
                        put(end, k, "_GAP", metres(p, n), seq)
        else:
            ends = edge_key.split("|")
            if len(ends) == 2 and ends[0] != ends[1] and coords and len(coords) >= 2:
                nodes.setdefault(ends[0], coords[0]), nodes.setdefault(ends[1], coords[-1])
                put(*ends, "_PREF", sum(metres(a, b) for a, b in zip(coords, coords[1:])), seq)
    return nodes, {k: v for k, v in edges.items() if v is not None}


def test_replay_in_order(spark):
    rng = random.Random(8)
    spot = lambda: (45.43 + rng.randrange(90) * 1.3e-4 + 1e-5, -122.6 - rng.randrange(90) * 1.3e-4 - 1e-5)
    base = {node(p): p for p in (spot() for _ in range(25))}
    names = sorted(base)
    connected = {"|".join(sorted(rng.sample(names, 2))) for _ in range(20)}
    prefs = []
    for seq in rng.sample(range(100), 40):
        coords = [spot()]
        for _ in range(rng.randrange(9)):
            coords.append((coords[-1][0] + rng.randrange(-8, 9) * 1e-4, coords[-1][1] + rng.randrange(-8, 9) * 1e-4))
        if rng.random() < 0.3:
            key = rng.choice([*sorted(connected), "|".join(sorted((node(coords[0]), node(coords[-1])))), "broken", "a|a"])
            prefs.append((seq, key, rng.choice([None, [key]]), rng.choice([coords, None, coords[:1]])))
        else:
            prefs.append((seq, "x|y", ["x|y", "y|z"], coords))
    prefs.append((200, "x|y", ["x|y", "y|z"], prefs[0][3]))  # the same line once more: new nodes are in reach now
    nodes, edges = one_after_another(sorted(prefs, key=lambda p: p[0]), base, connected)
    drawn = spark.createDataFrame([(*p, "n") for p in prefs], "insert_seq long, edge_key string, all_edge_keys array<string>, coords array<struct<lat:double,lng:double>>, name string")
    nd = spark.createDataFrame([(k, *p) for k, p in base.items()], "node_key string, lat double, lng double").withColumns({"cell_lat": F.floor(F.col("lat") * 1000), "cell_lng": F.floor(F.col("lng") * 1000)})
    there = spark.createDataFrame([(k,) for k in connected], "key string")
    got = {r["key"]: (r["ct"], round(r["distance"], 6), r["insert_seq"]) for r in preferences.replayed(drawn, nd, there).collect()}
    assert got == edges and {v[0] for v in got.values()} == {"_PREF", "_GAP"} and len(got) > 60
    after = {r["node_key"]: (r["lat"], r["lng"]) for r in preferences.nodes_after(drawn, nd).collect()}
    assert after == nodes
