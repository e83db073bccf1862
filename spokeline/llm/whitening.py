"""Operator 13: whitening of embeddings from an exact integer scatter.

Each entry c becomes the integer x = floor(256 * c). Tasks subtract a shift (a vector of their own rows) from the distinct integer
vectors and sum these and their cross products without rounding: entries are cut into 16-bit limbs, whose products are exact
in doubles, and the sums are carried as four 40-bit limbs, so that Spark adds them as longs. Moved back by the shift, the sums of all tasks make n * X'X - SS' as
integers of any size; only these are turned into doubles, divided by n * n and decomposed by eigh. Vectors are projected from
n * x - S, which is an exact integer, too.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are left out; a null vec_id is kept. An x beyond
a long stops at its ends. Repeated vectors count once in the fit and get a result in each row. Vectors of another length are fitted by themselves. There are as many
components as dimensions, four at most. A component without variance (its eigenvalue is not above rounding: 1e-12 of the trace) has a null `whitened`,
and no part in identity_error, which is the largest over all lengths (0 where no component has variance). A deviation that no long can hold is
null; deviation_text has it whatever its size. Of equal eigenvalues any basis may come, the same for all rows. An empty table gives no rows; other columns are not read.

Scale: tasks send sums of d * (d + 1) / 2 products, pre-aggregated; one task a length holds its d * d matrix, as eigh needs it. Rows are joined with the model of
their length; nothing passes through the driver but identity_error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, COMPONENTS = 256, 4
#: Rows that are multiplied at once: 2^34 (a product of limbs) times so many stays below 2^53.
BLOCK = 1 << 16
LIMBS, LIMB_BITS = 4, 40
#: An eigenvalue up to this share of the trace is rounding.
NO_VARIANCE = 1e-12
LONG = 1 << 63


def integers(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x (array of longs) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("size(v) > 0")
    rows = rows.where(F.forall("v", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))))  # NaN is above infinity in Spark
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE)))).alias("x"))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of the rows, their vectors as a matrix of longs) for each length in a column of arrays."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    begin = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, flat[begin[at][:, None] + np.arange(d)]


# -- exact sums -----------------------------------------------------------------------------------
def limbs_of(x: np.ndarray) -> list[np.ndarray]:
    """Signed 16-bit limbs of longs as doubles, the lowest first; the last has the sign."""
    return [((x >> (16 * k)) & 0xFFFF if k < 3 else x >> 48).astype(np.float64) for k in range(4)]


class Scatter:
    """Number, sums and sums of cross products of vectors of one length, exact, moved by a shift that is their first vector."""

    def __init__(self, shift: np.ndarray):
        d = len(shift)
        self.n, self.shift = 0, limbs_of(shift)
        self.first = [int(v) for v in shift]
        self.sums = np.zeros(d, object)
        self.products = np.zeros((d, d), object)

    def add(self, x: np.ndarray) -> None:
        for at in range(0, len(x), BLOCK):
            limbs = [a - b for a, b in zip(limbs_of(x[at : at + BLOCK]), self.shift, strict=True)]
            used = [(k, a) for k, a in enumerate(limbs) if a.any()]
            self.n += len(limbs[0])
            for k, a in used:
                self.sums += whole(a.sum(axis=0)) << 16 * k
            for i, (k, a) in enumerate(used):
                for m, b in used[i:]:
                    p = whole(a.T @ b)
                    self.products += (p if k == m else p + p.T) << 16 * (k + m)

    def unshifted(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of x, and of its cross products."""
        s = np.array(self.first, object)
        return self.sums + self.n * s, self.products + np.outer(s, self.sums) + np.outer(self.sums, s) + self.n * np.outer(s, s)


def whole(a: np.ndarray) -> np.ndarray:
    """Doubles that are integers, as integers of any size."""
    return a.astype(np.int64).astype(object)


def carried(values: list[int]) -> list[list[int]]:
    """Signed integers as limbs of LIMB_BITS, the lowest first, the last with the sign: their sums over tasks fit into longs."""
    mask = (1 << LIMB_BITS) - 1
    return [[v >> LIMB_BITS * k & mask if k < LIMBS - 1 else v >> LIMB_BITS * k for v in values] for k in range(LIMBS)]


def scatters(fit: DataFrame) -> DataFrame:
    """d, i, j and limbs l0.. of the sums over all vectors: of products (i, j), i <= j; of entries (-1, j); their number is at (-1, -1)."""
    names = ["d", "i", "j", *(f"l{k}" for k in range(LIMBS))]

    def summed(batches):
        known: dict[int, Scatter] = {}
        for b in batches:
            for _, x in matrices(b.column(0)):
                d = x.shape[1]
                if d not in known:
                    if len(known) >= 64:  # many lengths: hand on what is there, Spark adds it up
                        yield from flush(known)
                    known[d] = Scatter(x[0])
                known[d].add(x)
        yield from flush(known)

    def flush(known):
        for d, s in known.items():
            sums, products = s.unshifted()
            i, j = np.triu_indices(d)
            values = [s.n, *sums, *products[i, j]]
            keys = [np.full(len(values), d), np.r_[-1, np.full(d, -1), i], np.r_[-1, np.arange(d), j]]
            yield pa.RecordBatch.from_arrays([*(pa.array(k.astype(np.int32)) for k in keys), *(pa.array(v, pa.int64()) for v in carried(values))], names)
        known.clear()

    rows = fit.select("x").mapInArrow(summed, "d int, i int, j int, " + ", ".join(f"l{k} long" for k in range(LIMBS)))
    return rows.groupBy("d", "i", "j").agg(*(F.sum(n).alias(n) for n in names[3:]))


# -- models ---------------------------------------------------------------------------------------
def decomposed(n: int, sums: list[int], products: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest eigenvalues, their unit vectors as rows, and the trace, of the covariance (n * XX - SS) / n^2."""
    s = np.array(sums, object)
    exact = n * products - np.outer(s, s)
    cov = np.array([[int(v) / (n * n) for v in row] for row in exact])  # a quotient of integers is rounded once
    values, vectors = np.linalg.eigh(cov)
    k = min(COMPONENTS, len(values))
    return values[::-1][:k], vectors.T[::-1][:k], sum(int(exact[i, i]) for i in range(len(s))) / (n * n)


def models(fit: DataFrame) -> DataFrame:
    """d, n, sums (text of integers), eigenvalues, basis (row after row) and trace of each length."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(pdf["d"].iloc[0])
        value = sum(pdf[f"l{k}"].astype(object) * (1 << LIMB_BITS * k) for k in range(LIMBS))
        at = dict(zip(zip(pdf["i"], pdf["j"], strict=True), value, strict=True))
        products = np.zeros((d, d), object)
        for i in range(d):
            for j in range(i, d):
                products[i, j] = products[j, i] = at[i, j]
        sums = [at[-1, j] for j in range(d)]
        values, basis, trace = decomposed(at[-1, -1], sums, products)
        return pd.DataFrame({"d": [d], "n": [at[-1, -1]], "sums": [[str(v) for v in sums]], "eigenvalues": [values.tolist()], "basis": [basis.ravel().tolist()], "trace": [trace]})

    return scatters(fit).groupBy("d").applyInPandas(solve, "d int, n long, sums array<string>, eigenvalues array<double>, basis array<double>, trace double")


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: longs where all of them and the sum of their squares fit, else integers of any size."""
    most = max(n * max(int(x.max()), -int(x.min())), *(abs(s) for s in sums)) * 2
    if most * most * len(sums) < LONG:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def projected(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Sum of squared deviations and whitened coordinates (NaN without variance) of vectors."""
    n, sums = model["n"], [int(s) for s in model["sums"]]
    dev = deviations(x, n, sums)
    values = np.array(model["eigenvalues"])
    basis = np.array(model["basis"]).reshape(len(values), -1)
    centred = (dev / n).astype(np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = centred @ basis.T / np.sqrt(np.where(values > NO_VARIANCE * model["trace"], values, np.nan))
    return (dev * dev).sum(axis=1), out


MODEL = ["n", "sums", "eigenvalues", "basis", "trace"]


def with_models(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (with x) beside the model of their length; there are few models, so Spark's own size check makes this a broadcast."""
    return rows.withColumn("d", F.size("x")).join(known, "d")


def whitened(rows: DataFrame, known: DataFrame) -> DataFrame:
    """vec_id, d, n, deviation_text, explained and whitened (arrays over components) of each row."""
    rows = with_models(rows, known).select("vec_id", "x", *MODEL)

    def project(batches):
        for b in batches:
            for at, x in matrices(b.column("x")):
                model = {c: b.column(c)[int(at[0])].as_py() for c in MODEL}
                dev, w = projected(x, model)
                share = [v / model["trace"] if model["trace"] else 0.0 for v in model["eigenvalues"]]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("vec_id").take(pa.array(at)), pa.array(np.full(len(at), x.shape[1], np.int32)), pa.array(np.full(len(at), model["n"])), pa.array(list(map(str, dev)), pa.string()), pa.array([share] * len(at), pa.list_(pa.float64())),
                        pa.array([[None if v != v else v for v in row] for row in w.tolist()], pa.list_(pa.float64())),
                    ],
                    ["vec_id", "d", "n", "deviation_text", "explained", "whitened"],
                )

    return rows.mapInArrow(project, "vec_id long, d int, n long, deviation_text string, explained array<double>, whitened array<double>")


def identity_error(fit: DataFrame, known: DataFrame) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity (co-moments, centred before multiplying)."""
    w = whitened(fit.select(F.lit(None).cast("long").alias("vec_id"), "x"), known)
    w = w.select("d", *(F.get("whitened", F.lit(k)).alias(f"w{k}") for k in range(COMPONENTS)))
    pairs = [(i, j) for i in range(COMPONENTS) for j in range(i, COMPONENTS)]
    cov = w.groupBy("d").agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}{j}") for i, j in pairs))
    error = F.greatest(*(F.abs(F.col(f"c{i}{j}") - F.lit(float(i == j))) for i, j in pairs), F.lit(0.0))
    return cov.agg(F.coalesce(F.max(error), F.lit(0.0))).first()[0]


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error and deviation_text of every row that takes part."""
    rows = integers(embeddings, id_col, vector_col)
    fit = written(rows.select("x").distinct())
    known = written(models(fit))
    error = identity_error(fit, known)
    out = whitened(rows, known).select("vec_id", "n", "deviation_text", F.posexplode(F.arrays_zip("whitened", "explained")).alias("pos", "c"))
    return out.select(
        "vec_id", (F.col("pos") + 1).alias("component"), "n", F.expr("try_cast(deviation_text as bigint)").alias("deviation"), F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"),
        F.lit(error).alias("identity_error"), "deviation_text",
    )
