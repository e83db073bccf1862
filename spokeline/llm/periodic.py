"""Operator 12: periodic runs of words by the harmonic grid.

A run of period p holds two grid points jp and (j + 1)p, so for each p the longest common extensions of these points, forward and
backward, give all maximal stretches of period p: n/1 + n/2 + ... = O(n log n) pairs a text of n words. Points with different words extend
nothing and are left out at once. The others are answered by a suffix array over the words of a batch of texts (each between signs of its own, so
nothing extends beyond a text), its array of common prefixes and a range minimum over that; backward by the same over the
reversed words. A stretch found for several periods is the run of the smallest of them.

Suffixes are sorted by three words, then by doubling within groups that are still equal; common prefixes are compared where the words before
two neighbours differ, and are one less than those of the suffix before elsewhere.

Defined results: a null or empty text has no words and no runs; a null doc_id counts as one whose text is not changed. Whole texts are worked
on, however long: a text is worked on by one task, in memory that grows with its words. Repeated rows are counted each; other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shortest run.
LEAST = 12
#: Words of short texts that are sorted together, and grid pairs that are looked at at once.
BATCH_WORDS, PAIRS = 1 << 16, 1 << 21
BLOCK_BITS = 4


# -- suffix arrays --------------------------------------------------------------------------------
def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, place of each suffix) of positive integers whose last one occurs once."""
    n, m = len(s), int(s.max()) + 1
    h = 3 if m < 1 << 21 else 2
    key = s.astype(np.int64)
    for k in range(1, h):
        key = key * m
        key[:-k] += s[k:]
    sa = np.argsort(key)
    k = key[sa]
    rank = np.empty(n, np.int64)
    todo, group = None, np.arange(n)
    while True:
        first = np.empty(len(k), bool)
        first[0], first[1:] = True, k[1:] != k[:-1]
        head = np.maximum.accumulate(np.where(first, group, 0))
        rank[sa if todo is None else sa[todo]] = head
        single = first.copy()
        single[:-1] &= first[1:]
        group = group[~single]
        if not len(group):
            return sa, rank
        todo = group
        suffix = sa[todo]
        key = rank[suffix] * n + rank[suffix + h]
        order = np.argsort(key)
        sa[todo], k = suffix[order], key[order]
        h *= 2


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Words that each suffix shares with the one before it in order; 0 for the first."""
    n = len(s)
    before = np.empty(n, np.int64)
    before[sa[0]], before[sa[1:]] = -1, sa[:-1]
    i = np.arange(n)
    other = before > 0
    other[0] = False
    look = np.flatnonzero(~(other & (s[i - 1] == s[np.maximum(before, 1) - 1])) & (before >= 0))
    own = np.zeros(n, np.int64)  # of the suffixes that are compared
    a, b, shared = look, before[look], 0
    while len(a) > 16 or (len(a) and shared < 16):
        same = s[a + shared] == s[b + shared]
        own[a[~same]] = shared
        a, b = a[same], b[same]
        shared += 1
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        at, step = shared, 64
        while True:
            z = min(step, n - max(x, y) - at)
            differ = np.flatnonzero(s[x + at : x + at + z] != s[y + at : y + at + z])
            if len(differ):
                own[x] = at + differ[0]
                break
            at, step = at + z, step * 2
    anchor = np.full(n, -1, np.int64)
    anchor[look] = look
    anchor[sa[0]] = sa[0]
    anchor = np.maximum.accumulate(anchor)
    return (own[anchor] - (i - anchor))[sa]


class Minimum:
    """Minima of ranges of an array: of blocks by a table of powers of two, of their parts by running minima."""

    def __init__(self, x: np.ndarray):
        size = 1 << BLOCK_BITS
        self.x = np.concatenate([x, np.full(-len(x) % size + size, np.iinfo(np.int64).max)])
        blocks = self.x.reshape(-1, size)
        self.upto = np.minimum.accumulate(blocks, axis=1).ravel()
        self.onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        rows = [blocks.min(axis=1)]
        while 2 << (len(rows) - 1) <= len(blocks):
            low, half = rows[-1], 1 << (len(rows) - 1)
            new = low.copy()
            new[:-half] = np.minimum(low[:-half], low[half:])
            rows.append(new)
        self.table = np.stack(rows)
        self.log = np.frexp(np.arange(len(blocks) + 1))[1] - 1

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minimum of a..b, both included."""
        u, v = a >> BLOCK_BITS, b >> BLOCK_BITS
        out = np.minimum(self.onward[a], self.upto[b])
        wide = np.flatnonzero(v - u > 1)
        if len(wide):
            left, right = u[wide] + 1, v[wide]
            k = self.log[right - left]
            out[wide] = np.minimum(out[wide], np.minimum(self.table[k, left], self.table[k, right - (1 << k)]))
        one = np.flatnonzero(u == v)
        if len(one):
            x, y = a[one], b[one]
            best = self.x[x]
            for step in range(1, 1 << BLOCK_BITS):
                best = np.minimum(best, self.x[np.minimum(x + step, y)])
            out[one] = best
        return out


class Extensions:
    """Longest common extensions forward of two different places of a sequence."""

    def __init__(self, s: np.ndarray):
        sa, self.place = suffix_array(s)
        self.least = Minimum(common_prefixes(s, sa))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.place[i], self.place[j]
        return self.least.of(np.minimum(a, b) + 1, np.maximum(a, b))


# -- runs -----------------------------------------------------------------------------------------
def grid(s: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid points (place of the first, period) whose words agree, of all texts that begin at these places of s."""
    half = sizes // 2
    period = np.arange(half.sum()) - np.repeat(np.cumsum(half) - half, half) + 1
    at, pairs = np.repeat(begin, half), (np.repeat(sizes, half) - 1) // np.maximum(period, 1)
    upto = np.cumsum(pairs)
    found = []
    lo = 0
    while lo < len(period):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, side="right")))
        n = pairs[lo:hi]
        p = np.repeat(period[lo:hi], n)
        a = (np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)) * p + np.repeat(at[lo:hi], n)
        same = np.flatnonzero(s[a] == s[a + p])
        found.append((a[same], p[same]))
        lo = hi
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 2


def runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Rows (start, length, period) of each text's runs, by start, then period. Texts are arrays of positive integers."""
    sizes = np.array([len(t) for t in texts], np.int64)
    top = max((int(t.max()) for t in texts if len(t)), default=0)
    parts: list[np.ndarray] = [np.array([top + 1])]
    for k, t in enumerate(texts):
        parts += [t, np.array([top + 2 + k])]
    s = np.concatenate(parts).astype(np.int64)
    begin = np.cumsum(sizes + 1) - sizes
    a, p = grid(s, begin, sizes)
    none = np.zeros((0, 3), np.int64)
    if not len(a):
        return [none] * len(texts)
    after = Extensions(s).of(a, a + p)
    before = Extensions(s[::-1].copy()).of(len(s) - a, len(s) - a - p)  # places of the words before both points, in the reversed words
    start, end = a - before, a + p + after
    fits = np.flatnonzero(end - start >= np.maximum(LEAST, 2 * p))
    start, end, p = start[fits], end[fits], p[fits]
    order = np.lexsort((p, end, start))
    start, end, p = start[order], end[order], p[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, p = start[first], end[first], p[first]
    order = np.lexsort((p, start))
    found = np.stack([start, end - start, p], axis=1)[order]
    cut = np.searchsorted(found[:, 0], np.append(begin, len(s)))
    return [found[cut[k] : cut[k + 1]] - [begin[k], 0, 0] if cut[k] < cut[k + 1] else none for k in range(len(texts))]


def kept(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def source_places(doc_id: int | None, n: int) -> np.ndarray | None:
    """For texts whose end is made periodic: which word stands at each place; None for the others."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


NOTHING = digest(b"")
COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def summary(words: list[bytes], found: np.ndarray) -> tuple:
    """n_runs, start, length, period and exponent of the longest run, and both digests."""
    if not len(found):
        return 0, None, None, None, None, NOTHING, digest(b" ".join(words))
    start, length, period = found[np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]].tolist()
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in found.tolist())
    return len(found), start, length, period, 1000 * length // period, digest(listed.encode()), digest(b" ".join(compress(words, kept(len(words), found).tolist())))


def summaries(ids: list[int | None], texts: Iterator[bytes | None], planted: bool) -> Iterator[list[tuple]]:
    """Rows of a batch of texts, so many words at a time."""
    vocabulary: defaultdict[bytes, int] = defaultdict(count(1).__next__)
    rows: list[tuple[int | None, list[bytes], np.ndarray]] = []
    held = 0

    def flush():
        return [(i, *summary(words, found)) for (i, words, _), found in zip(rows, runs([x for _, _, x in rows]), strict=True)]

    for doc_id, text in zip(ids, texts, strict=True):
        words = text.split() if text else []  # of bytes: at the six ASCII white spaces and nothing else
        x = np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))
        places = source_places(doc_id, len(words)) if planted else None
        if places is not None:
            words, x = [words[k] for k in places.tolist()], x[places]
        rows.append((doc_id, words, x))
        held += len(words) + 1
        if held >= BATCH_WORDS:
            yield flush()
            rows, held = [], 0
            vocabulary.clear()
            vocabulary.default_factory = count(1).__next__
    if rows:
        yield flush()


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False) -> DataFrame:
    """COLUMNS of every row. planted: the ends of a tenth of the texts, by a hash of their id, are made periodic first."""

    def work(batches):
        for b in batches:
            for rows in summaries(b.column("doc_id").to_pylist(), (v.as_py() for v in b.column("text")), planted):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k > 5 else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))], COLUMNS)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def runs_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length and period (in words) of every run of every text."""

    def work(batches):
        for b in batches:
            vocabulary: defaultdict[bytes, int] = defaultdict(count(1).__next__)
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = text.split() if text else []
                (found,) = runs([np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))])
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(found), pa.int64()), *(pa.array(c) for c in found.T.copy())], ["doc_id", "start", "length", "period"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(work, "doc_id long, start long, length long, period long")
