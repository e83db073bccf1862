"""Helpers that several operators share: written intermediates, folds, connected components, word hashes."""

from __future__ import annotations

import ctypes
import gc
import uuid
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; where it is unset, one in the warehouse."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/intermediates")
    return sc.getCheckpointDir()


#: Intermediates that this driver wrote and did not remove yet.
_written: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_since(mark: int = 0) -> list[str]:
    """Paths of the intermediates written after the first `mark` ones; len(written_since()) is the mark of now."""
    return _written[mark:]


def remove_written(spark: SparkSession, paths: list[str]) -> None:
    """Remove intermediates that no result still to be computed reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        if path in _written:
            _written.remove(path)


def fold_of(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids are in fold 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds, F.lit(0))


def released() -> None:
    """At the end of a task: what its worker does not use any more goes back to the machine. Workers live on, and later stages need the memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


#: Bytes of rows that go to a Python worker at a time. Spark's default is sixteen times as many, which executor and worker hold for each task when rows are whole texts.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """df; from now on its session sends rows to Python workers by BATCH_BYTES at a time, or by less where that is set."""
    conf = df.sparkSession.conf
    set_now = conf.get(_BATCH)
    if not set_now.removesuffix("b").isdecimal() or int(set_now.removesuffix("b")) > BATCH_BYTES:
        conf.set(_BATCH, f"{BATCH_BYTES}b")
    return df


class WordHashes(dict):
    """word -> 32-bit hash, remembered up to a number of words, then forgotten as a whole; tasks clear it when they end."""

    LIMIT = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint32, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalising hash of unsigned integers (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of edges (a, b): node, root (the smallest node reachable).

    Alternates large-star and small-star steps (each a grouped minimum, so a hub with very many
    neighbours is pre-aggregated and never gathered), until a round changes nothing.
    Rows with a null end are dropped; a loop (a, a) yields a component of one node.
    """
    spark = edges.sparkSession
    own = edges.where("a is not null and b is not null").select(F.col("a").cast("long"), F.col("b").cast("long"))
    nodes = written(own.select(F.col("a").alias("node")).union(own.select("b")).distinct())
    e = written(own.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def minima(x: DataFrame, by: str) -> DataFrame:
        return x.groupBy(by).agg(F.min("m").alias("m"))

    before = None
    for _ in range(rounds):
        mark = len(written_since())
        # large star: every larger neighbour of u is linked to the smallest of u and its neighbours
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(minima(both.select("u", F.least("u", "v").alias("m")), "u"))  # so that both sides of the join are shuffled for it alone, and Spark can split a hub
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        # small star: u and its smaller neighbours are linked to the smallest of these
        large = written(large)
        low = written(minima(large.select("u", F.col("v").alias("m")), "u"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        e = written(small.distinct())
        remove_written(spark, written_since(mark)[:-1])  # of the round, only its edges are read again
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = minima(e.select("u", F.col("v").alias("m")), "u").withColumnRenamed("u", "node")
    return nodes.join(roots, "node", "left").select("node", F.coalesce("m", "node").alias("root"))


def local_roots(n: int, a: Iterable[int], b: Iterable[int]) -> np.ndarray:
    """Roots of 0..n-1 under links a[i]-b[i], by union and find."""
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return np.array([find(i) for i in range(n)], np.int64)
