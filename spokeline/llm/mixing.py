"""Operator 5: mixing sources to target weights.

Sizes are words. Each source's share of the mix is filled like water: shares by weight, none above `most` times its own
size, the excess shared anew; the sources are ranked and filled by prefix sums over ranges of them, however many there are.

A source's documents are dealt into blocks by a hash. Each pass over a source has its own permutation of the blocks, and a quota of
them: all blocks for whole passes, and for the pass in which the target ends as many as its rest asks for. A splitting tree
deals these quotas to the output shards: at each node the drawn units still to place, counted by source and pass, are split
exactly between the left and the right half of the shards by a multivariate hypergeometric draw, and so are the units that are
not drawn. A shard owns a slice of each permutation, as long as its two shares, and draws the first blocks of its slice, as many
as its quota: the draws of shards are disjoint. Blocks are not of equal size, so the words drawn are trued up to the target
in the order of how far blocks stand from their shard's quota; where the target ends within a block, whole parts of the
block and at last documents are taken in a permuted order. What is taken of a document, and which shards get its copies, both follow from
this one draw. A shard is then shuffled locally.

Defined results: a null text has size 0 and is taken 0 times; a null source is a source of its own, the last in order; rows that
repeat a doc_id are rows of their own (equal rows share the fate of one draw); rows of equal draws go by doc_id and size; an empty table gives an
empty mix; texts are counted whole, however long. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: Blocks of a source (fewer where the units of all sources would pass UNITS, what a hypergeometric draw takes), parts of a block, output shards.
BLOCKS, UNITS, PARTS, SHARDS = 4096, 1 << 28, 4096, 64
#: Groups of sources that the driver splits; each group's sources are split in a task of their own.
BUNDLES = 1024
SEED = 13


def words(text: Column) -> Column:
    """Runs of what is not a blank, tab, line end or such (x20, x09-x0D)."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    blank = F.translate(t, "\t\n\x0b\x0c\r", "     ")
    # runs begin at a non-blank after a blank: count them by what squeezing leaves
    return F.regexp_count(blank, F.lit("[^ ]+")).cast("long")


def ranged(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with running sums (of the rows before, named by `sums`) and `rank` (from 0) in a total order.

    Rows are dealt by ranges of the order; each range is summed by itself, and what lies before it is a number for each range.
    """
    held = written(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    each = held.groupBy("range").agg(F.count("*").alias("rank"), *[F.sum(c).alias(n) for n, c in sums.items()]).orderBy("range").toPandas()  # a row for each range
    names = ["rank", *sums]
    before = each[names].cumsum() - each[names]
    ahead = df.sparkSession.createDataFrame(pa.table({"range": each["range"].astype("int32")} | {f"ahead_{n}": before[n].astype("int64" if n == "rank" else "float64") for n in names}), "range int, " + ", ".join(f"ahead_{n} {'long' if n == 'rank' else 'double'}" for n in names))
    up_to = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = held.withColumns({"rank": F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1} | {n: F.coalesce(F.sum(c).over(up_to), F.lit(0)) for n, c in sums.items()})
    out = out.join(F.broadcast(ahead), "range")
    return out.withColumns({n: F.col(n) + F.col(f"ahead_{n}") for n in names}).drop("range", *[f"ahead_{n}" for n in names])


def targeted(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, rank (by code point, null last) and target, of rows of source and source_size.

    Sources of the least size for their weight stop first. In that order, one stops if what all before it leave, shared by weight among it and those after it, is above its cap.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = written(ranged(sources, [F.col("source").isNull(), F.encode("source", "UTF-8")], {}).withColumn("weight", weight))
    size, all_weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total = share * float(size or 0)
    cap = most * F.col("source_size")
    filled = ranged(ranked.withColumnRenamed("rank", "place"), [F.col("source_size") / F.col("weight"), F.col("place")], {"capped": cap.cast("double"), "weighed": F.col("weight")})
    level = (F.lit(total) - F.col("capped")) / (F.lit(float(all_weights or 0)) - F.col("weighed"))  # what a unit of weight gets if this and all after it stay open
    filled = written(filled.withColumn("level", level).withColumn("stops", F.col("level") * F.col("weight") > cap))
    # once one stays open all after it do, and its level is theirs
    open_level = filled.where("not stops").agg(F.min_by("level", "rank")).first()[0]
    return filled.select("source", "source_size", F.col("place").alias("rank"), F.when(F.col("stops"), cap).otherwise(F.lit(open_level) * F.col("weight")).alias("target"))


def split_tree(counts: np.ndarray, shards: int, seed: int = SEED, sizes: np.ndarray | None = None) -> np.ndarray:
    """Exact quotas, categories x shards: each node splits its counts by a multivariate hypergeometric draw.

    sizes: what each shard gets of all categories; even shares, if they are not given.
    """
    out = np.zeros((len(counts), shards), np.int64)
    total = int(counts.sum())
    sizes = np.diff([total * k // shards for k in range(shards + 1)]) if sizes is None else sizes
    ends = np.concatenate([[0], np.cumsum(sizes)])
    stack = [(0, shards, counts.astype(np.int64))]
    while stack:
        lo, hi, c = stack.pop()
        if hi - lo == 1:
            out[:, lo] = c
            continue
        mid = (lo + hi) // 2
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(c, int(ends[mid] - ends[lo]), method="marginals")
        stack += [(lo, mid, left), (mid, hi, c - left)]
    return out


def quotas(units: DataFrame, shards: int) -> DataFrame:
    """source, pass, quota (drawn units of each shard) and ends (where each shard's slice of the permutation ends).

    units: source, rank, pass, blocks and drawn. The driver splits the sums of BUNDLES groups of sources among the shards, and a task
    for each group splits its sources under what the group got, which is the same draw in two steps.
    """
    units = written(units)
    found = units.agg(F.max("rank")).first()[0]
    if found is None:
        return units.select("source", "pass", F.array().cast("array<long>").alias("quota"), F.array().cast("array<long>").alias("ends"))
    bundled = units.withColumn("bundle", F.floor(F.col("rank") / -(-(found + 1) // BUNDLES)).cast("int"))
    sums = bundled.groupBy("bundle").agg(F.sum("drawn").alias("drawn"), F.sum(F.col("blocks") - F.col("drawn")).alias("left")).orderBy("bundle").toPandas()  # BUNDLES rows at most
    given = {int(b): (d, u) for b, d, u in zip(sums["bundle"], split_tree(sums["drawn"].to_numpy(), shards), split_tree(sums["left"].to_numpy(), shards, SEED + 1), strict=True)}
    known = units.sparkSession.sparkContext.broadcast(given)

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "pass"])
        bundle = int(pdf["bundle"].iloc[0])
        drawn, left = known.value[bundle]
        quota = split_tree(pdf["drawn"].to_numpy(), shards, SEED + 2 + 2 * bundle, drawn)
        slices = quota + split_tree((pdf["blocks"] - pdf["drawn"]).to_numpy(), shards, SEED + 3 + 2 * bundle, left)
        return pd.DataFrame({"source": pdf["source"], "pass": pdf["pass"], "quota": list(quota), "ends": list(np.cumsum(slices, axis=1))})

    return bundled.groupBy("bundle").applyInPandas(split, "source string, pass int, quota array<long>, ends array<long>")


def _draw(source: Column, *parts: Column, salt: int) -> Column:
    return F.xxhash64(F.lit(SEED + salt), F.coalesce(source, F.lit("")), source.isNull(), *parts)


def _joined(a: DataFrame, b: DataFrame, *names: str, how: str = "inner") -> DataFrame:
    """a and b on columns that may be null."""
    b = b.withColumnsRenamed({n: f"__{n}" for n in names})
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"__{n}"))
    return a.join(b, on, how).drop(*[f"__{n}" for n in names])


def dealt(rows: DataFrame, weights: tuple[float, ...], share: float, most: float, shards: int) -> tuple[DataFrame, int]:
    """The draw, by blocks, and the number of blocks of a source.

    rows: source, draw and size. Returns source, block, source_size, target, whole (passes that take the block whole), cut (words of it that
    one more pass takes; null if none does), cut_pass, and shards (pass and shard of each pass that takes of it).
    """
    sources = written(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    n_blocks = max(1, min(BLOCKS, UNITS // max(1, sources.count())))
    in_block = F.pmod(F.col("draw"), F.lit(n_blocks)).cast("int")
    blocks = written(rows.groupBy("source", in_block.alias("block")).agg(F.sum("size").alias("words")))
    plan = targeted(sources, weights, share, most)
    plan = _joined(plan, blocks.groupBy("source").agg(F.count("*").alias("blocks")), "source")
    passes = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = written(plan.withColumn("times", passes))
    each = plan.where("times > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), (F.ceil("times") - 1).cast("int"))))
    each = each.withColumn("part", F.least(F.lit(1.0), F.col("times") - F.col("pass")))
    each = written(each.withColumn("drawn", F.least(F.col("blocks"), F.ceil(F.col("part") * F.col("blocks")))))
    quota = quotas(each.select("source", "rank", "pass", "blocks", "drawn"), shards)
    each = _joined(each, quota, "source", "pass").select("source", "pass", "source_size", (F.col("part") * F.col("source_size")).alias("wanted"), "quota", "ends")

    # each pass: a permutation of the source's blocks, slices of it for the shards, and the first blocks of each slice
    turned = _joined(blocks, each, "source")
    turn = F.row_number().over(Window.partitionBy("source", "pass").orderBy(_draw(F.col("source"), F.col("block"), F.col("pass"), salt=2), "block")) - 1
    turned = turned.withColumn("turn", turn).withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("turn"))).cast("int"))
    place = F.col("turn") - F.when(F.col("shard") > 0, F.element_at("ends", F.col("shard"))).otherwise(0)
    turned = turned.withColumn("beyond", place - F.element_at("quota", F.col("shard") + 1)).drop("quota", "ends")
    # true up to the target: blocks in the order of how far they are from their shard's quota (BLOCKS rows at most)
    order = Window.partitionBy("source", "pass").orderBy("beyond", "shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    turned = turned.withColumn("ahead", F.coalesce(F.sum("words").over(order), F.lit(0)))
    taken = F.greatest(F.lit(0.0), F.least(F.col("words").cast("double"), F.col("wanted") - F.col("ahead")))
    taken = turned.withColumn("got", F.when(F.col("wanted") >= F.col("source_size"), F.col("words").cast("double")).otherwise(taken)).where("got > 0")
    is_whole = F.col("got") >= F.col("words")
    drawn = taken.groupBy("source", "block").agg(
        F.count_if(is_whole).alias("whole"), F.max(F.when(~is_whole, F.col("got"))).alias("cut"), F.max(F.when(~is_whole, F.col("pass"))).alias("cut_pass"),
        F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("shards"),
    )
    out = _joined(_joined(blocks, plan.select("source", "source_size", "target"), "source"), drawn, "source", "block", how="left")
    return written(out.drop("words").withColumn("whole", F.coalesce("whole", F.lit(0)))), n_blocks


def drawn_rows(rows: DataFrame, size: Column, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, shards: int = SHARDS) -> DataFrame:
    """rows (with source, draw and what `size` reads) with source_size, target, whole, extra (words of one more pass) and shards."""
    plan, n_blocks = dealt(rows.select("source", "draw", size.alias("size")), weights, share, most, shards)
    rows = rows.withColumn("block", F.pmod(F.col("draw"), F.lit(n_blocks)).cast("int"))
    rows = _joined(rows, plan, "source", "block")
    last = lambda s: F.filter(s, lambda x: x["pass"] != F.col("cut_pass"))
    whole = rows.where("cut is null").withColumn("extra", F.lit(0).cast("long"))
    # the one block of a source in which its target ends: parts of it by a running sum, then the documents of one part
    cut = rows.where("cut is not null").withColumns({"part": F.pmod(F.xxhash64("draw", F.lit(SEED + 4)), F.lit(PARTS)).cast("int"), "words": size})
    parts = cut.groupBy("source", "part", "cut").agg(F.sum("words").alias("in_part"))
    over = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("rest", F.col("cut") - F.coalesce(F.sum("in_part").over(over), F.lit(0))).drop("cut")
    cut = _joined(cut, parts, "source", "part")
    sure = cut.where("rest <= 0 or rest >= in_part").withColumn("extra", F.when(F.col("rest") > 0, F.col("words")).otherwise(0))
    inner = Window.partitionBy("source").orderBy("draw", "doc_id", "words").rowsBetween(Window.unboundedPreceding, -1)
    split = cut.where("rest > 0 and rest < in_part").withColumn("ahead", F.coalesce(F.sum("words").over(inner), F.lit(0)))
    split = split.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("words"), F.floor(F.col("rest") - F.col("ahead") + 0.5)))).drop("ahead")
    cut = sure.unionByName(split).withColumn("shards", F.when(F.col("extra") > 0, F.col("shards")).otherwise(last("shards"))).drop("part", "words", "in_part", "rest")
    return whole.unionByName(cut.withColumn("extra", F.col("extra").cast("long"))).drop("cut", "cut_pass", "block")


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    """The columns that decide a row's draw."""
    source, doc_id = F.col(source_col).cast("string"), F.col(id_col).cast("long")
    text = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return {"source": source, "doc_id": doc_id, "draw": _draw(source, F.coalesce(doc_id, F.lit(0)), text, salt=1)}


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, shards: int = SHARDS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted), shards (of each copy) and place (order within them)."""
    cols = keyed(docs, id_col, text_col, source_col)
    rows = written(docs.select(*[c.alias(n) for n, c in cols.items()], words(F.col(text_col)).alias("size")))
    out = drawn_rows(rows, F.col("size"), weights, share, most, shards)
    # within a shard rows are in the order of a hash that no source or block steers
    taken = (F.col("whole") * F.col("size") + F.col("extra")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), F.col("shards.shard").alias("shards"), F.xxhash64("draw", F.lit(SEED + 3)).alias("place"))


def write_shards(mixed: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write the mix with one folder for each shard, a row for each copy, each shard in its shuffled order."""
    rows = mixed.where("taken > 0").withColumn("shard", F.explode("shards")).drop("shards")
    rows.repartition(shards, "shard").sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(path)


def draw(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """The mix itself: rows of docs, all columns, as often as they are taken, always whole.

    The one document of a source in which its target ends is taken if half of its words or more are. Texts without words are in no mix.
    """
    cols = keyed(docs, id_col, text_col, source_col)
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in cols.items()])
    size = words(F.col("row")[text_col])
    out = drawn_rows(held, size, **params)
    copies = F.col("whole") + F.when((F.col("extra") > 0) & (2 * F.col("extra") >= size), 1).otherwise(0)
    has_words = F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    out = out.where(has_words).withColumn("copies", copies.cast("int")).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
