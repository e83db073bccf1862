"""Operator 8: n-gram Jaccard join with a MinHash LSH forest and exact verification.

A text's set is its shingles of five words (lower case, split at white space); a text of one to four words has one shingle
of all its words. Texts with equal sets are one node with a number of copies. Each node gets `trees` labels of `depth`
minima; the branches of a tree are the prefixes of its labels. Matched prefixes
start at full depth and are shortened level by level, for all texts alike, until two things hold: the chance that a pair of exactly
the threshold shares a branch of some tree reaches the target recall, and so does (against the target of the audit) the recall
measured for a bounded set of audited texts, whose partners are all found by exact comparison in the pass that signs the
texts. Half of these are drawn among all texts, half among those that begin and end like another text, which says nothing of their signatures. Where fewer than
AUDIT_LINKED of them have a partner, their recall says too little, and prefixes are one minimum shorter than the chance asks for. Nodes under one
branch of that level are candidates. (A trie whose texts stop at prefixes of their own would stop early only where partners are known already, and lose those at the threshold.)

Verification is exact. A node's home is the most crowded branch that it or a node it meets is in; homes are dealt into blocks
of bounded size, whose pairs are all compared, and a node is sent to those blocks of other homes alone in which it has a candidate. Two blocks are compared by a
product of their 0/1 matrices, so a hot branch is dealt over many tasks, and links are counted where they are found and
never listed.

Defined results: null and empty texts (no words) link with nothing and are each a class of their own; n_links counts other
rows at the threshold or above, copies included; class_id is the smallest doc_id that links reach (null where the class
has none); rows without a doc_id take part, as do rows that repeat a doc_id with another text. Very long texts are cut into shingles whole.
Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, components, local_roots, mix64, released, small_batches, written

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 24, 8
RECALL = 0.999
#: Texts whose partners are found exactly (of each half), how many of them must have one, and the mean recall that these must show.
AUDITED, AUDIT_LINKED, AUDIT_RECALL = 64, 32, 0.98
#: Characters of an audited text at most, and those of the beginning and of the end that two texts share, for the half that looks like others.
AUDIT_CHARS, BEGINNING = 200_000, 60
#: Texts of a block, and shingles of all of them (a single text may have more).
BLOCK, BLOCK_SHINGLES = 384, 1 << 19
SEED = 11

hashes = WordHashes()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words).astype(np.uint64)
    if len(h) < SHINGLE:
        out = mix64(np.array([len(h)], np.uint64))
        for x in h:
            out = mix64(out ^ x)
        return out
    out = h[: len(h) - SHINGLE + 1] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(1, SHINGLE):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : len(h) - SHINGLE + 1 + k]
    return np.unique(mix64(out))


def meets(similarity: float, depth: int, trees: int) -> float:
    """The chance that two sets of this Jaccard similarity share a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def forest_level(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, measured: dict[int, float] | None = None) -> int:
    """Shorten matched prefixes from full depth until pairs at the threshold meet with the target recall, and the audited ones did.

    measured: recall of the audited texts by level; empty where too few had a partner, which costs one more level; None: not audited.
    """
    while depth > 1 and (meets(threshold, depth, trees) < recall or (measured or {}).get(depth, 1.0) < AUDIT_RECALL):
        depth -= 1
    return max(1, depth - 1) if measured == {} else depth


def signature(sets: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """trees x depth minima of 32-bit multiplicative hashes, the upper halves of each: what sorts a tree's labels."""
    rng = np.random.default_rng(SEED)
    mul = (rng.integers(1 << 32, size=trees * depth, dtype=np.uint64) | 1).astype(np.uint32)
    xor = rng.integers(1 << 32, size=trees * depth, dtype=np.uint64).astype(np.uint32)
    low = (sets >> np.uint64(32)).astype(np.uint32)
    best = np.full(trees * depth, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        x = (low[at : at + 2048, None] ^ xor) * mul
        np.minimum(best, x.min(axis=0), out=best)
    return (mix64(best) >> np.uint64(48)).astype(">u2").reshape(trees, depth)  # 16 bits of a hash of each minimum


def node_of(sets: np.ndarray) -> int:
    """64 bits of a digest of the set."""
    return int.from_bytes(hashlib.md5(sets.tobytes()).digest()[:8], "little", signed=True)


class Audit:
    """The sets of the audited texts, and which of them a text links with."""

    def __init__(self, texts: list[str], trees: int, depth: int):
        sets = {node_of(s): s for s in map(shingles, texts) if len(s)}
        self.nodes, self.sizes = list(sets), np.array([len(s) for s in sets.values()])
        flat = np.concatenate([np.empty(0, np.uint64), *sets.values()])
        owner = np.repeat(np.arange(len(sets)), self.sizes) if sets else np.empty(0, int)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.values, self.begin = np.unique(flat[order], return_index=True)
        self.ends = np.append(self.begin[1:], len(flat))
        self.labels = np.stack([signature(s, trees, depth) for s in sets.values()]) if sets else None

    def met(self, node: int, s: np.ndarray, label: np.ndarray, threshold: float) -> list[int]:
        """For each audited partner: its number and the longest prefix that any tree shares, in one integer."""
        if self.labels is None:
            return []
        at = np.searchsorted(self.values, s)
        at = at[at < len(self.values)] if at[-1] >= len(self.values) else at
        at = at[self.values[at] == s[: len(at)]]
        if not len(at):
            return []
        many = self.ends[at] - self.begin[at]
        first = np.repeat(self.begin[at] - np.cumsum(many) + many, many)
        meet = np.bincount(self.owner[first + np.arange(many.sum())], minlength=len(self.sizes))
        out = []
        for k in np.flatnonzero(meet >= threshold * (len(s) + self.sizes - meet) - 1e-9):
            if self.nodes[k] != node:
                shared = np.cumprod(self.labels[k] == label, axis=1).sum(axis=1).max()
                out.append(int(k) * 64 + int(shared))
        return out


def signed(rows: DataFrame, audit: Audit, threshold: float, trees: int, depth: int) -> DataFrame:
    """doc_id, h (hash of the text), node, size (shingles), labels of all trees in a row, and audited links of each row."""
    known = rows.sparkSession.sparkContext.broadcast(audit)  # the sets of AUDITED texts

    def sign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                got = []
                for t in b.column("text").to_pylist():
                    s = shingles(t)
                    if not len(s):
                        got.append((None, 0, None, []))
                        continue
                    node, label = node_of(s), signature(s, trees, depth)
                    got.append((node, len(s), label.tobytes(), known.value.met(node, s, label, threshold)))
                node, size, label, met = zip(*got, strict=True)
                cols = [b.column("doc_id"), b.column("h"), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(label, pa.binary()), pa.array(met, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "node", "size", "labels", "met"])
        hashes.clear()
        released()

    return rows.mapInArrow(sign, "doc_id long, h binary, node long, size long, labels binary, met array<int>")


def audited_texts(rows: DataFrame) -> list[str]:
    """AUDITED texts of all, and AUDITED of those that begin and end like another text; of at most AUDIT_CHARS characters. rows: doc_id, text, h."""
    fit = rows.where(F.col("text").rlike(r"\S") & (F.length("text") <= AUDIT_CHARS))
    order = [F.xxhash64("doc_id", F.length("text")), "doc_id", "text"]
    some = [r[0] for r in fit.orderBy(*order).limit(AUDITED).select("text").collect()]
    alike = fit.groupBy(F.concat(F.substring("text", 1, BEGINNING), F.lit("\n"), F.substring("text", -BEGINNING, BEGINNING)).alias("start")).agg(F.min("h").alias("h"), F.max("h").alias("other")).where("h <> other")
    drawn = alike.orderBy(F.xxhash64("start"), "start").limit(AUDITED).select("h")
    return some + sorted({r[0] for r in fit.join(F.broadcast(drawn), "h", "left_semi").groupBy("h").agg(F.any_value("text").alias("text")).select("text").collect()})


def audited_recall(sig: DataFrame, depth: int) -> dict[int, float]:
    """Mean recall of the audited texts that have links, at each level; empty where fewer than AUDIT_LINKED have any."""
    rows = sig.select(F.explode("met").alias("met")).groupBy("met").count().collect()  # 2 x AUDITED x levels rows at most
    links = np.zeros((2 * AUDITED, depth + 1))
    for met, n in rows:
        links[met // 64, met % 64] += n
    links = links[links.sum(axis=1) > 0]
    return {d: float((links[:, d:].sum(axis=1) / links.sum(axis=1)).mean()) for d in range(1, depth + 1)} if len(links) >= AUDIT_LINKED else {}


def compared(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between two blocks (or within one): counts of each text, and a spanning forest of the links.

    Intersections are counted by a product of 0/1 matrices over slices of the shared shingles.
    """
    first = pdf["i"].iloc[0] == pdf["j"].iloc[0]
    left = pdf[pdf["block"] == pdf["i"]]
    right = left if first else pdf[pdf["block"] == pdf["j"]]
    both = left if first else pd.concat([left, right])
    n, m = len(left), len(right)
    sets = [np.frombuffer(s, np.uint64) for s in both["shingles"]]
    sizes = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, place, seen = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(seen > 1)  # a shingle that one text alone has is in no intersection
    slot = np.full(len(values), -1)
    slot[shared] = np.arange(len(shared))
    at = slot[place]
    owner, at = owner[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    meet = np.zeros((n, m))
    for lo in range(0, len(shared), 4096):
        a, b = np.searchsorted(at, [lo, lo + 4096])
        x = np.zeros((len(sets), min(4096, len(shared) - lo)), np.float32)
        x[owner[a:b], at[a:b] - lo] = 1
        meet += x[:n] @ (x[:n] if first else x[n:]).T
    sa, sb = sizes[:n], sizes[:n] if first else sizes[n:]
    linked = meet >= threshold * (sa[:, None] + sb[None, :] - meet) - 1e-9
    if first:
        np.fill_diagonal(linked, False)
    ids, copies = both["node"].to_numpy(), both["copies"].to_numpy()
    counts = linked @ (copies if first else copies[n:])
    if not first:
        counts = np.concatenate([counts, linked.T @ copies[:n]])
    a, b = np.nonzero(np.triu(linked) if first else linked)
    roots = local_roots(len(ids), a, b if first else b + n)
    out = pd.DataFrame({"node": ids, "root": ids[roots], "n": counts.astype(np.int64)})
    return out[(out["n"] > 0) | (out["node"] != out["root"])]


def classified(docs: DataFrame, id_col: str, text_col: str, threshold: float, trees: int, depth: int, recall: float) -> DataFrame:
    """doc_id, h, n_links, lead_id and lead_h (the first row of the class) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("h"))
    sig = written(signed(rows, Audit(audited_texts(rows), trees, depth), threshold, trees, depth))
    level = forest_level(threshold, trees, depth, recall, audited_recall(sig, depth))

    # nodes: texts of the same set, with the first of their rows
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("first")
    nodes = written(sig.where("node is not null").groupBy("node").agg(first, F.count("*").alias("copies"), F.any_value("size").alias("size"), F.any_value("labels").alias("labels")))

    # branches of the level with more than one node
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    branch = F.xxhash64("tree", F.substring(F.col("labels"), F.col("tree") * (2 * depth) + 1, F.lit(2 * level)))
    entries = nodes.select("node", "size", "labels", tree.alias("tree")).select("node", "size", branch.alias("branch"))
    crowded = entries.groupBy("branch").agg(F.count("*").alias("n")).where("n > 1")
    met = written(entries.join(crowded, "branch").select("node", "size", "branch", "n"))

    # homes: each node's most crowded branch, then the most crowded home among all that it meets, so that a group of near copies has one
    top = met.groupBy("node").agg(F.max(F.struct("n", "branch")).alias("top"))
    of_branch = met.select("node", "branch").join(top, "node").groupBy("branch").agg(F.max("top").alias("top"))
    home = written(met.join(of_branch, "branch").groupBy("node").agg(F.max("top").alias("top"), F.any_value("size").alias("size")).select("node", "size", F.col("top.branch").alias("home")))
    crowds = home.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    home = home.drop("size").join(crowds, "home")
    block = lambda salt: F.xxhash64("home", salt.cast("int"))
    home = home.withColumn("block", block(F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks"))))
    placed = written(home.join(nodes.select("node", "first", "copies"), "node"))
    within = placed.select("node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"), "home").select("node", "block", block(F.col("salt")).alias("other"))
    # candidates in blocks of other homes: where a branch reaches them
    at = met.select("node", "branch").join(placed.select("node", "home", "block"), "node")
    reached = at.select("branch", F.col("home").alias("other_home"), F.col("block").alias("other")).distinct()
    several = reached.groupBy("branch").agg(F.min("other_home").alias("low"), F.max("other_home").alias("high")).where("low < high").select("branch")
    across = at.join(several, "branch", "left_semi").join(reached, "branch").where("home <> other_home").select("node", "block", "other").distinct()
    sent = within.union(across).select("node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    # the text of a node's first row is cut into its set once
    wanted = placed.select("node", "copies", "block", F.col("first.doc_id").alias("first_id"), F.col("first.h").alias("first_h"))
    wanted = rows.join(wanted.hint("shuffle_hash"), (rows["h"] == wanted["first_h"]) & rows["doc_id"].eqNullSafe(wanted["first_id"])).select("node", "copies", "block", "text")

    def cut(batches):
        for b in batches:
            sets = [shingles(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "copies", "block")), pa.array(sets, pa.binary())], ["node", "copies", "block", "shingles"])
        hashes.clear()
        released()

    sets = wanted.mapInArrow(cut, "node long, copies long, block long, shingles binary").dropDuplicates(["node"])
    found = written(sets.join(sent, "node").groupBy("i", "j").applyInPandas(lambda pdf: compared(pdf, threshold), "node long, root long, n long"))

    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = written(components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))))
    leads = roots.join(nodes.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("lead"))
    leads = roots.join(leads, "root").select("node", "lead")
    of_node = nodes.select("node", "first", "copies").join(links, "node", "left").join(leads, "node", "left")
    of_node = of_node.select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("lead", "first").alias("lead"))
    out = sig.where("node is not null").select("doc_id", "h", "node").join(of_node, "node").select("doc_id", "h", "n_links", F.col("lead.doc_id").alias("lead_id"), F.col("lead.h").alias("lead_h"))
    lone = sig.where("node is null").select("doc_id", "h", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("lead_id"), F.col("h").alias("lead_h"))
    return out.unionByName(lone)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """doc_id, n_links, class_id and kept (doc_id = class_id) of every row."""
    out = classified(docs, id_col, text_col, threshold, trees, depth, recall)
    return out.select("doc_id", "n_links", F.col("lead_id").alias("class_id"), F.col("doc_id").eqNullSafe(F.col("lead_id")).alias("kept"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The first row of each class, all columns: of the smallest doc_id, rows without one last. Texts without words all stay.

    Rows that agree in id and text are one.
    """
    out = classified(docs, id_col, text_col, threshold, TREES, DEPTH, RECALL)
    first = written(out.where(F.col("doc_id").eqNullSafe(F.col("lead_id")) & (F.col("h") == F.col("lead_h"))).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct())
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumns({"__doc": F.col(id_col).cast("long"), "__text": F.unhex(F.md5(text.cast("binary")))})
    kept = keyed.join(first, keyed["__doc"].eqNullSafe(first["__id"]) & (keyed["__text"] == first["__h"]), "left_semi")
    return kept.dropDuplicates(["__doc", "__text"]).drop("__doc", "__text")
