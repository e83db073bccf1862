"""Whitening from exact integer sums, against fractions and numpy."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from spokeline.llm import whitening


def brute(rows):
    """n, S, covariance (fractions) of the distinct integer vectors."""
    x = sorted({tuple(math.floor(256 * c) for c in v) for v in rows})
    n, d = len(x), len(x[0])
    s = [sum(v[i] for v in x) for i in range(d)]
    cov = [[sum(Fraction(n * v[i] - s[i], n) * Fraction(n * v[j] - s[j], n) for v in x) / n for j in range(d)] for i in range(d)]
    return n, s, cov


def test_against_fractions(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 6)) * [3, 2, 1, 0.5, 0.2, 0.1] + [1000, 0, -7, 0, 0, 1e6]
    x[10:60] = x[5]  # copies count once
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(None, x[0].tolist()), (900, None), (901, [1.0] * 5 + [None]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, []), (905, x[1].tolist()), (905, x[1].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(7).withColumn("x", F.lit(1)).withColumn("d", F.lit(2)).withColumn("n", F.lit(3))
    got = whitening.whiten(df).toPandas()
    n, s, cov = brute(x.tolist())
    assert len(got) == 4 * (300 + 3) and set(got["n"]) == {n} and got["vec_id"].isna().sum() == 4
    values, vectors = np.linalg.eigh(np.array(cov, float))
    trace = float(sum(cov[i][i] for i in range(6)))
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-8
    for k in range(1, 5):
        part = got[(got["component"] == k) & got["vec_id"].notna() & (got["vec_id"] < 900)].set_index("vec_id").sort_index()
        assert np.allclose(part["explained"], values[-k] / trace, rtol=1e-9)
        xi = np.floor(256 * x)
        want = np.array([[float(Fraction(n * int(c) - t, n)) for c, t in zip(v, s, strict=True)] for v in xi]) @ vectors[:, -k] / np.sqrt(values[-k])
        sign = np.sign((want * part["whitened"]).sum())
        assert np.allclose(part["whitened"] * sign, want, atol=1e-7)
        assert part["deviation"].tolist() == [sum((n * int(c) - t) ** 2 for c, t in zip(v, s, strict=True)) for v in xi]
    assert whitening.whiten(df.limit(0)).count() == 0


def test_scatter_of_any_size():
    """Sums of longs at both ends of their range, in several tasks' worth of blocks, are exact."""
    rng = np.random.default_rng(5)
    x = rng.integers(-(2**63), 2**63 - 1, (50, 5), dtype=np.int64)
    x[0], x[1] = 2**63 - 1, -(2**63)
    s = whitening.Scatter(x[7])
    s.add(x[:20]), s.add(x[20:])
    sums, products = s.unshifted()
    big = x.astype(object)
    assert s.n == 50 and sums.tolist() == big.sum(axis=0).tolist() and products.tolist() == (big.T @ big).tolist()
    for v in [0, 1, -1, 2**126 * 50, -(2**126) * 50, *products.ravel()]:
        assert sum(int(limb[0]) << 40 * k for k, limb in enumerate(whitening.carried([int(v)]))) == v
        assert all(abs(limb[0]) < 2**53 for limb in whitening.carried([int(v)]))


def test_odd_tables(spark):
    """One vector, no variance, few dimensions, several lengths, entries beyond a long, deviations beyond a long."""
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert len(one) == 4 and all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, None, 0.0, 0.0) for r in one)
    rows = [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0]), (4, [5.0]), (5, [-0.001]), (6, [1e30, 0.0, 1.0]), (7, [-1e30, 0.0, 2.0])]
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == 6 + 2 + 6 and got[1, 2]["whitened"] is None and got[4, 1]["n"] == 2 and got[1, 1]["n"] == 3
    assert math.isclose(abs(got[1, 1]["whitened"]), math.sqrt(1.5)) and math.isclose(abs(got[4, 1]["whitened"]), 1.0)
    assert got[5, 1]["deviation"] == (2 * -1 - (1280 - 1)) ** 2
    far = (2 * (2**63 - 1) - (2**63 - 1 - 2**63)) ** 2 + (2 * 256 - 768) ** 2
    assert got[6, 1]["deviation"] is None and int(got[6, 1]["deviation_text"]) == far
    assert got[1, 1]["identity_error"] < 1e-9
