"""Operator 9: approximate nearest neighbours by multi-index hashing.

A rotation learned on a bounded sample (principal axes, then iterative quantisation; several such rotations of the axes where vectors have fewer
components than codes have bits) turns each vector into a binary code. Codes are cut into substrings of 16 bits, each with an
index of its own. If two codes differ in r bits at most, then some substring differs in r // m bits at most (m substrings), so
probing these buckets of every index finds every code within the Hamming radius. What is found is ranked by exact
Euclidean distance of the original vectors.

Each index is spread over tasks by the leading bits of its substring, as many bits as bring a task to SHARD_ROWS rows, and a
query is sent to those tasks alone whose leading bits it can probe; a bucket range that holds more rows is dealt in blocks. In a task,
rows stand in posting lists by substring, and a query reads the lists it probes and no other row. A code that several indexes find is ranked
by the first of them. The radius is learned on the sample, where neighbours are farther than in the whole table; queries that find fewer
than asked for search again at twice the radius, up to all bits.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id; vectors
have a distance to vectors of their own length only, and each length is indexed by itself; ties go to the smaller vec_id; all rows of a query's
vec_id are its own and no candidates; of a vec_id with several vectors each row is a candidate, its nearest row counts, and the vector that sorts first is the
query; a table with one usable row or none gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .vectors import stacked, usable

BITS, PART = 64, 16
#: Rows of a length that the rotation and the radius are learned on, at most: those with the smallest hashes of a share of them.
SAMPLE = 8192
#: Share of the sample's true neighbours that are within the radius.
WITHIN = 0.96
SHARD_ROWS, BLOCK_QUERIES = 8192, 4096
SEED = 5


def learn(x: np.ndarray, bits: int = BITS, k: int = 10) -> dict:
    """Centre, projection (dimensions x bits) and radius of codes, from sample vectors."""
    rng = np.random.default_rng(SEED)
    mean = x.mean(axis=0)
    c = x - mean
    width = min(x.shape[1], bits)
    axes = np.linalg.eigh(c.T @ c)[1][:, ::-1][:, :width]
    v = c @ axes
    turns = []
    for _ in range(-(-bits // width)):
        turn = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for _ in range(30):  # iterative quantisation: alternate codes and the rotation nearest to them
            u, _, w = np.linalg.svd(v.T @ np.where(v @ turn >= 0, 1.0, -1.0))
            turn = u @ w
        turns.append(axes @ turn)
    model = {"mean": mean, "project": np.hstack(turns)[:, :bits], "radius": bits}
    if len(x) > k + 1:
        q = rng.permutation(len(x))[:256]
        codes = encode(x, model)
        gap = ((x[q] ** 2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x[q] @ x.T).copy()
        gap[np.arange(len(q)), q] = np.inf
        near = np.argpartition(gap, k, axis=1)[:, :k]
        apart = np.bitwise_count(codes[q][:, None] ^ codes[near])
        model["radius"] = int(np.quantile(apart, WITHIN, method="higher"))
    return model


def encode(x: np.ndarray, model: dict) -> np.ndarray:
    """64-bit codes of vectors."""
    bits = ((x - model["mean"]) @ model["project"]) >= 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def substrings(codes: np.ndarray) -> np.ndarray:
    return codes.view(np.uint16).reshape(len(codes), BITS // PART)


def reach(radius: int, part: int, parts: int = BITS // PART) -> int:
    """Bits in which a substring may differ: pigeonhole, the first radius % parts + 1 of them in radius // parts, the others in one less."""
    return min(PART, radius // parts - (part > radius % parts))


class Postings:
    """The codes of some rows as posting lists by one of their substrings."""

    MASKS = np.arange(1 << PART, dtype=np.uint16)[np.argsort(np.bitwise_count(np.arange(1 << PART, dtype=np.uint16)), kind="stable")]
    WITHIN = np.searchsorted(np.bitwise_count(MASKS), np.arange(PART + 1), side="right")

    def __init__(self, codes: np.ndarray, part: int):
        self.codes, self.part = codes, part
        own = substrings(codes)[:, part]
        self.rows = np.argsort(own, kind="stable")
        self.keys, self.begin = np.unique(own[self.rows], return_index=True)
        self.ends = np.append(self.begin[1:], len(codes))

    def probed(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows of the lists that a query probes."""
        r, mine = reach(radius, self.part), substrings(np.array([code], np.uint64))[0, self.part]
        if r < 0:
            return np.empty(0, np.int64)
        if self.WITHIN[r] < len(self.keys):  # look up each bucket within reach, or go over the buckets there are
            want = np.sort(self.MASKS[: self.WITHIN[r]] ^ mine)
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            at = at[self.keys[at] == want]
        else:
            at = np.flatnonzero(np.bitwise_count(self.keys ^ mine) <= r)
        many = self.ends[at] - self.begin[at]
        first = np.repeat(self.begin[at] - np.cumsum(many) + many, many)
        return self.rows[first + np.arange(many.sum())]

    def within(self, code: np.uint64, radius: int) -> tuple[np.ndarray, int]:
        """Rows that this index is the first to find within the radius, and how many rows were looked at."""
        at = self.probed(code, radius)
        apart = self.codes[at] ^ code
        good = np.bitwise_count(apart) <= radius
        parts = substrings(apart)
        for before in range(self.part):
            good &= np.bitwise_count(parts[:, before]) > reach(radius, before)
        return at[good], len(at)


def search_block(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest that a piece of an index finds for each query of a block; a row without vec_id tells what was looked at."""
    out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "looked": []}).astype({"query_id": "int64", "vec_id": "Int64", "looked": "int64"})]
    if len(rows) and len(queries):
        ids, x = rows["vec_id"].to_numpy(), stacked(rows["x"])
        index, q = Postings(rows["code"].to_numpy().view(np.uint64), int(rows["part"].iloc[0])), stacked(queries["x"])
        for query_id, v, code, radius in zip(queries["vec_id"].to_numpy(), q, queries["code"].to_numpy().view(np.uint64), queries["radius"].to_numpy(), strict=True):
            at, looked = index.within(code, int(radius))
            at = at[ids[at] != query_id]
            d = np.sqrt(((x[at] - v) ** 2).sum(axis=1))
            best = np.lexsort((ids[at], d))
            best = best[np.sort(np.unique(ids[at][best], return_index=True)[1])][:k] if len(best) else best
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": pd.array(ids[at][best], "Int64"), "score": d[best], "looked": 0}))
            out.append(pd.DataFrame({"query_id": [query_id], "vec_id": pd.array([None], "Int64"), "score": [0.0], "looked": [looked]}))
    return pd.concat(out)


def coded(rows: DataFrame, models) -> DataFrame:
    def code(batches):
        for pdf in batches:
            for d, part in pdf.groupby("d"):
                yield part.assign(code=encode(stacked(part["x"]), models.value[d]).view(np.int64))

    return rows.mapInPandas(code, "vec_id long, x array<double>, d int, is_query boolean, code long")


def found_by(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, vec_id, score of what the indexes find, and looked (rows read for a query) in rows without vec_id."""
    spark = df.sparkSession
    rows = written(usable(df, id_col, vector_col, F.coalesce(is_query, F.lit(False)).alias("is_query")).withColumn("d", F.size("x")))
    schema = "query_id long, vec_id long, score double, looked long"
    counts = {r["d"]: r["count"] for r in rows.groupBy("d").count().collect()}  # a row for each length
    if not counts:
        return spark.createDataFrame([], schema)
    # a share of each length's rows that holds about twice the sample, so that no task gets a length whole
    bound = F.create_map(*[F.lit(x) for d, n in counts.items() for x in (d, int(min(1.0, 2 * SAMPLE / n) * (1 << 30)))])
    hashed = F.xxhash64("vec_id", "x")
    turn = F.row_number().over(Window.partitionBy("d").orderBy(hashed, "vec_id", "x"))
    sample = rows.where(F.pmod(hashed, F.lit(1 << 30)) < bound[F.col("d")]).withColumn("turn", turn).where(F.col("turn") <= SAMPLE).select("d", "x").toPandas()
    learned = {int(d): learn(stacked(part["x"]), k=k) for d, part in sample.groupby("d")}
    codes = written(coded(rows, spark.sparkContext.broadcast(learned)))
    lead = min(PART, max(0, int(np.ceil(np.log2(max(counts.values()) / SHARD_ROWS)))))  # leading bits that deal an index to tasks

    parts = F.explode(F.sequence(F.lit(0), F.lit(BITS // PART - 1)))
    sub = F.expr(f"shiftrightunsigned(code, part * {PART}) & {(1 << PART) - 1}")
    placed = codes.select("vec_id", "x", "d", "code", parts.alias("part")).withColumn("range", F.shiftright(sub, PART - lead).cast("int"))
    sizes = placed.groupBy("d", "part", "range").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("blocks"))
    by = {n: F.col(n) for n in ("d", "part", "range")}
    radii = F.create_map(*[F.lit(x) for d, m in learned.items() for x in (d, m["radius"])])
    queries = written(codes.where("is_query").groupBy("vec_id").agg(F.min(F.struct("x", "d", "code")).alias("q")).select("vec_id", "q.*").withColumn("radius", radii[F.col("d")]))
    # the ranges within so many bits of a query's own, for each number of bits: only these are asked
    masks = spark.range(1 << lead).select(F.explode(F.sequence(F.bit_count("id").cast("long"), F.lit(lead).cast("long"))).alias("may"), F.col("id").cast("int").alias("mask"))
    all_found = None
    while True:
        may = F.floor(F.col("radius") / (BITS // PART)) - (F.col("part") > F.col("radius") % (BITS // PART)).cast("int")
        asked = queries.withColumn("part", parts).withColumns({"mine": F.shiftright(sub, PART - lead).cast("int"), "may": F.least(may, F.lit(lead))}).where("may >= 0")
        asked = asked.join(masks, "may").withColumn("range", F.col("mine").bitwiseXOR(F.col("mask"))).drop("mine", "may", "mask").join(sizes, [*by])
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        crowd = asked.groupBy(*by, "block").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("crowds"))
        asked = asked.drop("blocks").join(crowd, [*by, "block"]).withColumn("crowd", F.pmod(F.xxhash64("vec_id"), F.col("crowds")).cast("int")).drop("crowds")
        held = placed.join(sizes, [*by]).withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.col("blocks")).cast("int")).drop("blocks")
        held = held.join(crowd, [*by, "block"]).withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1))).drop("crowds")
        group, named = [*by, "block", "crowd"], ["g1", "g2", "g3", "g4", "g5"]
        key = lambda t: t.withColumns({g: F.col(c).cast("long") for g, c in zip(named, group, strict=True)}).groupBy(*named)
        found = written(key(held).cogroup(key(asked)).applyInPandas(lambda a, b: search_block(a, b, k), schema))
        all_found = found if all_found is None else all_found.union(found)
        enough = found.where("vec_id is not null").groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"))
        queries = written(queries.where(F.col("radius") < BITS).join(enough, "vec_id", "left_anti").withColumn("radius", F.least(F.lit(BITS), F.greatest(F.lit(1), F.col("radius") * 2))))
        if queries.isEmpty():
            return all_found


def search(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (distance) of the k nearest rows found for each query row."""
    found = found_by(df, is_query, k, id_col, vector_col).where("vec_id is not null").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
