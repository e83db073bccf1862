"""Operator 3: near-duplicate vectors by a robust-pruned flat graph.

Vectors of a label are dealt to the nearest of its cluster centres and the next one, so that shards overlap. In each shard every
vector's nearest neighbours are pruned robustly (a neighbour is dropped that a kept one is much nearer to), and the
shards' adjacency lists are united, both directions. Vectors are searched in cells, those with near
home centres; a vector asks every cell that can hold a partner of it (a bound that loses none), whatever the size of its label. Searches start at the shards' medoids,
at the vector's own node and at its own list, go greedily to the nearest nodes, then expand from every node within reach until no more are found. What is found is
verified by the exact cosine in double precision. Recall is audited against brute force for a bounded set of
vectors, each with the same weight; where too few of them have links, vectors that the search did link are audited too. While recall is below the target, degree,
candidates and beam are doubled, one more shard overlaps
and the search is done again. Where the largest degree does not reach it, every cell is compared whole, which is exact.

Equal vectors of a label are one node with a number of copies. Pairs are counted where they are found and never listed. Defined
results: rows whose label is null or whose vector is null, zero or holds null or non-finite components link with nothing
and are components of their own; vectors link with vectors of their own length only; rows without an id take part, and a component without any id has
none; rows that repeat a vec_id count as copies. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, written
from .vectors import finite, stacked

THRESHOLD = 0.93
#: Rows of a shard, wished for; centres of all labels together, at most (they are broadcast).
SHARD_ROWS, MAX_CENTRES = 1024, 8192
#: Rows of a block of a shard (a task holds two), nodes of a cell that one task holds; queries of one search task.
BLOCK, CELL, QUERIES = 2048, 8192, 1024
CANDIDATES, DEGREE, ALPHA, BEAM = 48, 16, 1.2, 24
#: Shards that a vector is dealt to, at first.
SHARDS = 2
#: Largest degree that is tried before cells are compared whole.
MAX_DEGREE = 8 * DEGREE
#: Similarity below the threshold from which nodes are still expanded.
SLACK = 0.04
#: Vectors audited at random; with links, so many are wanted, else so many linked ones are audited too; mean recall they must show.
AUDITED, ENOUGH, AUDITED_LINKED, RECALL = 4096, 32, 256, 0.98


def prune(x: np.ndarray, at: int, near: np.ndarray, sims: np.ndarray, degree: int) -> list[int]:
    """Robust pruning of a node's candidates, nearest first: keep one, drop those that it is much nearer to."""
    gap = np.sqrt(np.maximum(0, 2 - 2 * sims))
    kept: list[int] = []
    alive = np.ones(len(near), bool)
    v = x[near]
    for k in range(len(near)):
        if not alive[k]:
            continue
        kept.append(int(near[k]))
        if len(kept) >= degree:
            break
        between = np.sqrt(np.maximum(0, 2 - 2 * (v @ v[k])))
        alive &= ALPHA * between > gap
    return kept


def build(pdf: pd.DataFrame, degree: int) -> pd.DataFrame:
    """Pruned edges within a block of a shard, or between two blocks of it."""
    first = pdf["i"].iloc[0] == pdf["j"].iloc[0]
    x, ids, block = stacked(pdf["x"]), pdf["rep"].to_numpy(), pdf["block"].to_numpy()
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    if not first:
        sims[block[:, None] == block[None, :]] = -2
    most = min(max(CANDIDATES, CANDIDATES * degree // DEGREE), len(x) - 1)
    src, dst, score = [], [], []
    if most > 0:
        near = np.argpartition(-sims, most - 1, axis=1)[:, :most]
        for at in range(len(x)):
            s = sims[at, near[at]]
            order = np.argsort(-s, kind="stable")
            order = order[s[order] > -2]
            kept = prune(x, at, near[at][order], s[order], degree)
            src += [ids[at]] * len(kept)
            dst += ids[kept].tolist()
            score += sims[at, kept].tolist()
    return pd.DataFrame({"label": pdf["label"].iloc[0], "src": np.array(src, np.int64), "dst": np.array(dst, np.int64), "sim": np.array(score, np.float64)})


def search(nodes: pd.DataFrame, queries: pd.DataFrame, threshold: float, beam: int) -> pd.DataFrame:
    """For each query: weight of the nodes within reach, and the smallest id of its links' component among these nodes.

    Queries from other cells enter by their own links too. A beam of 0 compares with every node.
    """
    if nodes.empty or queries.empty:
        return pd.DataFrame({"rep": [], "n": [], "root": []}).astype("int64")
    ids, x, copies = nodes["rep"].to_numpy(), stacked(nodes["x"]), nodes["copies"].to_numpy()
    order = np.argsort(ids)
    ids, x, copies = ids[order], x[order], copies[order]
    lists = [v if v is not None else () for v in nodes["near"].iloc[order]]
    src, dst = np.repeat(np.arange(len(ids)), [len(v) for v in lists]), np.concatenate([np.empty(0, np.int64), *lists]).astype(np.int64)
    at = np.searchsorted(ids, dst)
    there = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == dst)
    src, at = src[there], at[there]
    # both directions of every edge among these nodes, so that whoever reaches a node is reached from it
    flat = np.unique(np.concatenate([src * len(ids) + at, at * len(ids) + src]))
    begin, ends = np.searchsorted(flat // len(ids), np.arange(len(ids) + 1)), flat % len(ids)
    # medoids of the shards
    starts = [int(np.flatnonzero(mask)[np.argmax(x[mask] @ x[mask].mean(axis=0))]) for c in nodes["centre"].unique() if (mask := nodes["centre"].to_numpy()[order] == c).any()]
    walk = (ids, x, copies, begin, ends, starts)
    return pd.concat([searched(*walk, queries.iloc[lo : lo + QUERIES], threshold, beam) for lo in range(0, len(queries), QUERIES)])


def searched(ids: np.ndarray, x: np.ndarray, copies: np.ndarray, begin: np.ndarray, ends: np.ndarray, starts: list[int], queries: pd.DataFrame, threshold: float, beam: int) -> pd.DataFrame:
    """The search of one piece of the queries."""
    q, asked = stacked(queries["q"]), queries["asked"].to_numpy()
    n, m = len(ids), len(asked)
    sims = np.full((m, n), -2.0)  # of the pairs looked at

    def look(rows: np.ndarray, cols: np.ndarray) -> None:
        for lo in range(0, len(rows), 200_000):
            r, c = rows[lo : lo + 200_000], cols[lo : lo + 200_000]
            sims[r, c] = np.einsum("ij,ij->i", q[r], x[c])

    def neighbours(rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of each row with the neighbours of its node, those not looked at yet."""
        many = begin[cols + 1] - begin[cols]
        first = np.repeat(begin[cols] - np.cumsum(many) + many, many)
        pairs = np.unique(np.repeat(rows, many) * n + ends[first + np.arange(many.sum())])
        pairs = pairs[sims.ravel()[pairs] == -2]
        return pairs // n, pairs % n

    width = min(beam, n)
    best, best_sims = np.zeros((m, width), np.int64), np.full((m, width), -2.0)  # each query's nearest nodes so far

    def merge(rows: np.ndarray, cols: np.ndarray) -> None:
        """Looked-at pairs, sorted by row, into the beams; the cost is that of the pairs, however many nodes there are."""
        nonlocal best, best_sims
        if not len(rows):
            return
        many = np.bincount(rows, minlength=m)
        slot = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
        more, more_sims = np.zeros((m, many.max()), np.int64), np.full((m, many.max()), -2.0)
        more[rows, slot], more_sims[rows, slot] = cols, sims[rows, cols]
        all_cols, all_sims = np.hstack([best, more]), np.hstack([best_sims, more_sims])
        top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        best, best_sims = np.take_along_axis(all_cols, top, 1), np.take_along_axis(all_sims, top, 1)

    def walk() -> None:
        """Fills in sims where the graph leads."""
        # medoids, each query's own node and those that its own list names
        lists = [v if v is not None else () for v in queries["known"]]
        of, named = np.repeat(np.arange(m), [len(v) for v in lists]), np.concatenate([np.empty(0, np.int64), *lists]).astype(np.int64)
        at = np.searchsorted(ids, named)
        there = (at < n) & (ids[np.minimum(at, n - 1)] == named)
        begun = np.unique(np.concatenate([*(np.arange(m) * n + s for s in starts), here * n + own[here], of[there] * n + at[there]]))
        begun_rows, begun_cols = begun // n, begun % n
        look(begun_rows, begun_cols)
        merge(begun_rows, begun_cols)

        expanded = np.zeros((m, n), bool)
        for _ in range(4 * beam):  # greedy: each query expands the nearest of its beam that is not expanded yet
            open_sims = np.where(expanded[np.arange(m)[:, None], best], -2, best_sims)
            pick = open_sims.argmax(axis=1)
            rows = np.flatnonzero(open_sims[np.arange(m), pick] > -2)
            if not len(rows):
                break
            cols = best[rows, pick[rows]]
            expanded[rows, cols] = True
            pairs = neighbours(rows, cols)
            look(*pairs)
            merge(*pairs)
        rows, cols = np.nonzero((sims >= threshold - SLACK) & ~expanded)
        while len(rows):  # range expansion: from all nodes within reach
            expanded[rows, cols] = True
            within = []
            for lo in range(0, len(rows), 100_000):
                r, c = neighbours(rows[lo : lo + 100_000], cols[lo : lo + 100_000])
                look(r, c)
                near = sims[r, c] >= threshold - SLACK
                within.append((r[near], c[near]))
            rows, cols = map(np.concatenate, zip(*within, strict=True))

    own = np.searchsorted(ids, asked)
    here = np.flatnonzero((own < n) & (ids[np.minimum(own, n - 1)] == asked))
    if beam == 0:
        sims = q @ x.T
    else:
        walk()

    linked = sims >= threshold
    linked[here, own[here]] = False
    weight = linked @ copies
    rows, cols = np.nonzero(linked)
    root, mine = ids.copy(), asked.copy()  # smallest ids spread over the links until nothing changes
    while True:
        before = root.copy(), mine.copy()
        np.minimum.at(mine, rows, root[cols])
        mine[here] = np.minimum(mine[here], root[own[here]])
        np.minimum.at(root, cols, mine[rows])
        root[own[here]] = np.minimum(root[own[here]], mine[here])
        if (before[0] == root).all() and (before[1] == mine).all():
            break
    out = pd.DataFrame({"rep": asked, "n": weight.astype(np.int64), "root": mine})
    moved = root != ids  # nodes that a query linked tell their root too
    return pd.concat([out, pd.DataFrame({"rep": ids[moved], "n": 0, "root": root[moved]})])


def _builder(degree: int):
    return lambda pdf: build(pdf, degree)


def _searcher(threshold: float, beam: int):
    return lambda nodes, queries: search(nodes, queries, threshold, beam)


def exact_links(nodes: DataFrame, sample: pd.DataFrame, threshold: float) -> dict[int, int]:
    """Weights of all nodes of the same label within reach of a bounded sample of nodes, by brute force."""
    known = nodes.sparkSession.sparkContext.broadcast({label: (part["rep"].to_numpy(), stacked(part["x"])) for label, part in sample.groupby("label")})

    def counted(batches):
        total = {label: np.zeros(len(reps), np.int64) for label, (reps, _) in known.value.items()}
        for pdf in batches:
            for label, part in pdf.groupby("label"):
                if label in total:
                    reps, q = known.value[label]
                    for lo in range(0, len(part), 1024):
                        x = part.iloc[lo : lo + 1024]
                        hit = (q @ stacked(x["x"]).T >= threshold) & (reps[:, None] != x["rep"].to_numpy()[None])
                        total[label] += hit @ x["copies"].to_numpy()
        for label, n in total.items():
            yield pd.DataFrame({"rep": known.value[label][0], "n": n})

    got = nodes.select("rep", "label", "copies", "x").mapInPandas(counted, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    return {r["rep"]: r["n"] for r in got.collect()}


def recall(got: dict[int, int], truth: dict[int, int]) -> float:
    """Mean recall of the audited vectors that have links, so that a large group does not outweigh small ones; 1 without any."""
    return float(np.mean([min(got.get(r, 0), n) / n for r, n in truth.items() if n] or [1.0]))


def links(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = df.sparkSession
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda v: v + 0.0)  # one zero, without a sign
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"), F.col(label_col).cast("string").alias("given"))
    takes_part = F.coalesce(F.col("given").isNotNull() & (F.size("x") > 0) & finite("x"), F.lit(False))
    # vectors of other lengths are other labels
    rows = rows.select("vec_id", "x", F.when(takes_part, F.concat_ws("/", F.size("x"), "given")).alias("label"))
    rows = rows.withColumn("rep", F.when(F.col("label").isNotNull(), F.xxhash64("label", "x")))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    nodes = rows.where("label is not null").groupBy("rep").agg(F.any_value("label").alias("label"), F.any_value("x").alias("x"), F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    nodes = written(nodes.select("label", "rep", "first", "copies", F.transform("x", lambda v: v / norm).alias("x")))
    total = nodes.count()

    # centres: rows whose hash falls below a bound that keeps their number below MAX_CENTRES
    share = min(1 / SHARD_ROWS, MAX_CENTRES / 2 / max(1, total))
    drawn = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(share * (1 << 30))
    centres = nodes.where(drawn).select("label", "rep", "x").toPandas()
    # centres that are near each other share a cell of about CELL / 2 rows
    together = max(1, int(CELL / 2 * share))
    table = {}
    for label, part in centres.sort_values("rep").groupby("label"):
        reps, c = part["rep"].to_numpy(), stacked(part["x"])
        table[label] = reps, c, reps[np.argmax(c @ c[: -(-len(c) // together)].T, axis=1)]
    known = spark.sparkContext.broadcast(table)
    reach = float(np.sqrt(1 - threshold * threshold)) if threshold > 0 else 1.0

    def pieces(batches):
        for pdf in batches:
            for label, part in pdf.groupby("label"):
                for lo in range(0, len(part), 1024):
                    yield known.value.get(label), part.iloc[lo : lo + 1024]

    def dealt(turns: int):
        def deal(batches):
            for got, part in pieces(batches):
                if got is None:
                    yield part.assign(centre=-1)
                    continue
                order = np.argsort(-(stacked(part["x"]) @ got[1].T), axis=1, kind="stable")[:, :turns]
                for turn in range(order.shape[1]):
                    yield part.assign(centre=got[0][order[:, turn]])

        return deal

    def routed(batches):
        """Each vector's home, and all cells that can hold a partner: a partner whose home is c lies beyond the plane halfway from
        the query's home to c, and the query is no further from that plane than the threshold's angle."""
        for got, part in pieces(batches):
            if got is None:
                yield part.assign(centre=-1, cell=-1, cells=[[-1]] * len(part))
                continue
            reps, c, cell_of = got
            sims = stacked(part["x"]) @ c.T
            at = sims.argmax(axis=1)
            apart = np.sqrt(np.maximum(0, 2 - 2 * (c[at] @ c.T)))
            may = sims.max(axis=1)[:, None] - sims <= reach * apart + 1e-9
            yield part.assign(centre=reps[at], cell=cell_of[at], cells=[np.unique(cell_of[m]).tolist() for m in may])

    cols = "label string, rep long, copies long, x array<double>"
    cells = written(nodes.select("label", "rep", "copies", "x").mapInPandas(routed, cols + ", centre long, cell long, cells array<long>"))
    asking = cells.select("label", F.explode("cells").alias("cell")).groupBy("label", "cell").agg(F.count("*").alias("asking"))
    sizes = cells.groupBy("label", "cell").agg(F.ceil(F.count("*") / CELL).cast("int").alias("node_blocks")).join(asking, ["label", "cell"])
    sizes = written(sizes.select("label", "cell", "node_blocks", F.ceil(F.col("asking") / (2 * QUERIES)).cast("int").alias("query_blocks")))

    def edges_of(degree: int, turns: int) -> DataFrame:
        """Pruned edges of shards that each vector is dealt to so many of."""
        shards = written(nodes.select("label", "rep", "copies", "x").mapInPandas(dealt(turns), cols + ", centre long"))
        per_shard = shards.groupBy("label", "centre").agg(F.count("*").alias("rows"))
        # a task holds two blocks, so a shard of no more is one block
        per_shard = per_shard.select("label", "centre", F.when(F.col("rows") <= 2 * BLOCK, 1).otherwise(F.ceil(F.col("rows") / BLOCK)).cast("int").alias("blocks"))
        in_blocks = shards.join(per_shard, ["label", "centre"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        in_blocks = in_blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
        return in_blocks.groupBy("label", "centre", "i", "j").applyInPandas(_builder(degree), "label string, src long, dst long, sim double")

    audited = nodes.orderBy(F.xxhash64("rep", F.lit(2))).limit(AUDITED).select("rep", "label", "x").toPandas()
    truth = exact_links(nodes, audited, threshold) if len(audited) else {}
    degree, beam, turns = DEGREE, BEAM, SHARDS
    while True:
        edges = edges_of(degree, turns) if beam else spark.createDataFrame([], "label string, src long, dst long, sim double")
        both = edges.union(edges.select("label", F.col("dst").alias("src"), F.col("src").alias("dst"), "sim"))
        united = both.groupBy("label", F.col("src").alias("rep")).agg(F.slice(F.sort_array(F.collect_set(F.struct("sim", "dst")), asc=False), 1, 4 * degree)["dst"].alias("near"))
        ready = cells.join(united, ["label", "rep"], "left")
        upto = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
        block = lambda salt, blocks: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(blocks)).cast("int")
        as_nodes = ready.join(sizes, ["label", "cell"]).withColumn("nb", block(0, "node_blocks")).withColumn("qb", upto("query_blocks"))
        as_queries = ready.drop("cell").withColumn("cell", F.explode("cells")).join(sizes, ["label", "cell"]).withColumn("qb", block(1, "query_blocks")).withColumn("nb", upto("node_blocks"))
        group, named = ["label", "cell", "nb", "qb"], ["g1", "g2", "g3", "g4"]
        key = [F.col(c).alias(g) for c, g in zip(group, named, strict=True)]
        as_nodes = as_nodes.select(*key, "rep", "copies", "x", "centre", "near")
        as_queries = as_queries.select(*key, F.col("rep").alias("asked"), F.col("x").alias("q"), F.col("near").alias("known"))
        found = as_nodes.groupBy(*named).cogroup(as_queries.groupBy(*named)).applyInPandas(_searcher(threshold, beam), "rep long, n long, root long")
        found = written(found)
        counts = written(found.groupBy("rep").agg(F.sum("n").alias("n")))
        if sum(n > 0 for n in truth.values()) < ENOUGH and beam:
            linked = counts.where("n > 0").orderBy(F.xxhash64("rep", F.lit(3))).limit(AUDITED_LINKED)
            linked = nodes.join(F.broadcast(linked), "rep").select("rep", "label", "x").toPandas()
            truth |= exact_links(nodes, linked, threshold) if len(linked) else {}
        known_truth = spark.createDataFrame([(int(r),) for r, n in truth.items() if n], "rep long")
        got = {r["rep"]: r["n"] for r in counts.join(F.broadcast(known_truth), "rep").collect()}  # AUDITED + AUDITED_LINKED rows at most
        if beam == 0 or recall(got, truth) >= RECALL:
            break
        degree, beam, turns = (degree * 2, beam * 2, turns + 1) if degree < MAX_DEGREE else (degree, 0, turns)

    classes = written(components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep"))
    smallest = classes.join(nodes.select("rep", "first"), "rep").groupBy("root").agg(F.min("first").alias("smallest"))
    classes = classes.join(smallest, "root").select("rep", "smallest", F.lit(True).alias("in_class"))
    of_node = nodes.select("rep", "first", "copies").join(counts, "rep", "left").join(classes, "rep", "left")
    of_node = of_node.select("rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(F.col("in_class"), F.col("smallest")).otherwise(F.col("first")).alias("component_id"))
    out = rows.where("rep is not null").select("vec_id", "rep").join(of_node, "rep").select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("rep is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
