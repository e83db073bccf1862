"""Periodic runs against a search from the definition."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from spokeline.llm import periodic


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i + q] for i in range(len(w) - q)))


def brute(w):
    """Every stretch that its neighbours end, tried by its definition."""
    out, n = [], len(w)
    for p in range(1, n // 2 + 1):
        s = 0
        while s + p < n:
            e = s + p
            while e < n and w[e] == w[e - p]:
                e += 1
            if e - s >= max(12, 2 * p) and (s == 0 or w[s - 1] != w[s - 1 + p]) and smallest_period(w[s:e]) == p:
                out.append((s, e - s, p))
            s = max(s + 1, e - p + 1) if e - s > p else s + 1
    return sorted(out)


def words_of(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


def expected(doc_id, text):
    w = words_of(doc_id, text)
    runs = brute(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def texts(seed, many):
    rng = random.Random(seed)
    for _ in range(many):
        n, k = rng.choice([0, 1, 3, 12, 13, 40, 90, 160]), rng.choice([1, 2, 3, 5, 40])
        w = [rng.choice("ab cdé")[:1].strip() or "x" for _ in range(n)] if k == 5 else [f"w{rng.randrange(k)}" for _ in range(n)]
        if n > 12 and rng.random() < 0.5:  # periodic from somewhere on
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(2, 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        yield rng.choice([" ", "\n", "\t ", " \x0b"]).join(w)


def test_runs_of_many_texts(spark):
    rows = list(enumerate(texts(4, 400)))
    rows += [(None, "a " * 30), (None, None), (7, None), (8, ""), (9, " \n\x0c "), (9, "a b " * 20), (10, "a b\x1fc " * 15), (11, "x " * 12), (11, "x " * 11), (-5, "p q " * 9), (-5, "p q " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("start", F.lit("s")).withColumn("n_runs", F.lit("n"))
    got = sorted((tuple(r) for r in periodic.find(df, planted=True).collect()), key=str)
    assert got == sorted((expected(*r) for r in rows), key=str)
    assert sum(r[1] for r in got) > 100 and max(r[1] for r in got) > 1
    assert periodic.find(df.limit(0), planted=True).count() == 0


def test_runs_as_rows(spark):
    rows = [(1, "a b c " * 5 + "x " * 20), (2, "no run here"), (3, None), (None, "z " * 12)]
    got = sorted((tuple(r) for r in periodic.runs_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 0, 15, 3), (1, 15, 20, 1), (None, 0, 12, 1)], key=str)


def test_extensions_of_every_pair():
    """Suffix array, common prefixes and minima against comparing words one by one, also of long stretches and many equal ones."""
    rng = np.random.default_rng(1)
    for s in [rng.integers(1, 3, 70), np.ones(60, int), np.tile([1, 2, 1], 30), np.r_[np.arange(1, 40), np.arange(1, 40)], rng.integers(1, 2**22, 50)]:
        s = np.append(s, s.max() + 1).astype(np.int64)
        e = periodic.Extensions(s)
        i, j = map(np.ravel, np.nonzero(~np.eye(len(s), dtype=bool)))
        want = [next(k for k in range(len(s)) if max(a, b) + k >= len(s) or s[a + k] != s[b + k]) for a, b in zip(i, j, strict=True)]
        assert e.of(i, j).tolist() == want


def test_long_texts_in_time():
    began = time.time()
    (one,) = periodic.runs([np.tile(np.array([1, 2, 3]), 50_000)])
    (two,) = periodic.runs([np.ones(100_000, np.int64)])
    fib = [np.array([1]), np.array([1, 2])]
    while len(fib[-1]) < 60_000:  # Fibonacci words have about n runs
        fib.append(np.concatenate([fib[-1], fib[-2]]))
    (many,) = periodic.runs([fib[-1]])
    assert one.tolist() == [[0, 150_000, 3]] and two.tolist() == [[0, 100_000, 1]] and 10_000 < len(many) < 75_025
    assert time.time() - began < 60
