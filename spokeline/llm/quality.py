"""Operator 2: quality by votes of the nearest labelled neighbours in a latent-semantic space.

Terms are hashed shapes (three character classes in a row), hashed words, and how much a text repeats itself. Term
weights are log(1 + count) times an inverse document frequency counted over all documents. The latent space is a
truncated singular value decomposition of the labelled sample; the sample's vectors are broadcast, every document's
cosines to all of them are computed exactly in blocks, and the nearest ones vote with their cosine as weight.

Defined results: a text without terms (null or empty), or without a neighbour of positive cosine, gets the share of
label 1 in the sample; without any labels every score is 0.5. Neighbours whose cosines agree to nine decimals are ties, which go to the
smaller doc_id. Texts are counted whole, however long.
A doc_id that labels give twice takes the larger label. Repeated rows are scored each; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, fold_of, released, small_batches

CLASSES = 48
SHAPES = 4096
WORDS = 1024
REPEATS = 16
TERMS = SHAPES + WORDS + REPEATS
#: Labelled rows that the model is fitted on, at most: those with the smallest hashes of doc_id.
MAX_LABELLED = 3000
DIMS = 64
NEIGHBOURS = 25
BLOCK = 256


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point: small and capital letters, digits, blank, line end, other; ASCII signs each by itself."""
    out = np.full(0x110000, 5, np.uint8)
    signs = 6
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            out[cp] = 1 if c.isupper() else 0
        elif c.isdigit():
            out[cp] = 2
        elif c in "\n\r":
            out[cp] = 4
        elif c.isspace():
            out[cp] = 3
        elif 33 <= cp <= 126:
            out[cp] = signs
            signs += 1
    return out


hashes = WordHashes()


def term_counts(text: str) -> np.ndarray:
    """Counts of all terms of a whole text."""
    out = np.zeros(TERMS, np.float32)
    words = text.split()
    if not words:
        return out
    c = classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint32)
    if len(c) > 2:
        g = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
        out[:SHAPES] = np.bincount((g * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=SHAPES)
    h = hashes.of(words)
    out[SHAPES : SHAPES + WORDS] = np.bincount(h % WORDS, minlength=WORDS)
    again = int((h[1:] == h[:-1]).sum())
    share = again / len(words)
    out[SHAPES + WORDS + min(7, int(share * 8))] = 1 + 20 * share
    fresh = len(np.unique(h)) / len(words)
    out[SHAPES + WORDS + 8 + min(7, int(fresh * 8))] = 1 if len(words) >= 20 else 0
    return out


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, float]:
    """In how many of all rows each term is, and the number of rows."""

    def counted(batches):
        df, n = np.zeros(TERMS + 1, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                for t in batch.slice(at, BLOCK).column("text").to_pylist():
                    df[:TERMS] += term_counts(t or "") > 0
                    n += 1
        df[TERMS] = n
        hashes.clear()
        released()
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "n"])

    out = np.zeros(TERMS + 1)
    for term, n in rows.select("text").mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n")).collect():  # TERMS + 1 rows at most
        out[term] = n
    return out[:TERMS], out[TERMS]


def weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return np.log1p(counts) * idf


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def latent(x: np.ndarray, dims: int, seed: int = 7) -> np.ndarray:
    """The leading right singular vectors of x, terms x dims, by subspace iteration."""
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(x @ rng.standard_normal((x.shape[1], min(dims + 16, *x.shape))).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
    return np.linalg.svd(q.T @ x, full_matrices=False)[2][:dims].T.astype(np.float32)


def labelled_sample(rows: DataFrame, labels: DataFrame, label_col: str, most: int) -> DataFrame:
    """doc_id, text and label of at most `most` labelled rows, those with the smallest hashes of doc_id; one row for each doc_id."""
    picked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where("doc_id is not null and label is not null")
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    # `most` rows of two numbers: a broadcast of known size
    return rows.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label").groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("x")).select("doc_id", "x.text", "x.label")


def fit(rows: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = MAX_LABELLED) -> dict | None:
    """Term weights, latent axes and the labelled vectors; None without labels."""

    def sparse(batches):
        for b in batches:
            got = [term_counts(t or "") for t in b.column("text").to_pylist()]
            at = [np.flatnonzero(x) for x in got]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([a.astype(np.uint16).tobytes() for a in at]), pa.array([x[a].tobytes() for x, a in zip(got, at, strict=True)])], ["doc_id", "label", "at", "counts"])

    sample = labelled_sample(rows, labels, label_col, most).mapInArrow(sparse, "doc_id long, label int, at binary, counts binary").toPandas().sort_values("doc_id")
    if sample.empty:
        return None
    df, n = document_frequencies(rows)
    idf = np.log((n + 1) / (df + 1)).clip(0).astype(np.float32)
    x = np.zeros((len(sample), TERMS), np.float32)
    for i, (at, counts) in enumerate(zip(sample["at"], sample["counts"], strict=True)):
        x[i, np.frombuffer(at, np.uint16)] = np.frombuffer(counts, np.float32)
    x = unit(weights(x, idf))
    axes = latent(x, DIMS)
    label = sample["label"].to_numpy(np.float64)
    return {"idf": idf, "axes": axes, "vectors": unit(x @ axes), "labels": label, "prior": float(label.mean())}


def votes(texts: list[str | None], model: dict) -> np.ndarray:
    """Scores of a block of texts: exact cosines to all labelled vectors, the nearest ones weighted by theirs."""
    x = np.stack([term_counts(t or "") for t in texts])
    z = unit(unit(weights(x, model["idf"])) @ model["axes"])
    cos = np.round(z.astype(np.float64) @ model["vectors"].T.astype(np.float64), 9)
    k = min(NEIGHBOURS, cos.shape[1])
    least = np.partition(cos, -k, axis=1)[:, -k:].min(axis=1, keepdims=True)
    above, equal = cos > least, cos == least
    # labelled vectors stand by doc_id: of those that tie for the last places the first ones vote
    near = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    w = np.where(near, np.maximum(cos, 0), 0)
    total = w.sum(axis=1)
    return np.where(total > 0, (w * model["labels"]).sum(axis=1) / np.maximum(total, 1e-12), model["prior"]).clip(0, 1)


def predict(rows: DataFrame, model: dict | None, folds: int = 5, held: int = 0) -> DataFrame:
    known = rows.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                s = votes(b.column("text").to_pylist(), known.value) if known.value else np.full(b.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.3).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
        hashes.clear()
        released()

    rows = rows.select("doc_id", (fold_of(F.col("doc_id"), folds) == held).alias("held_out"), "text")
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row; labels of fold 0 of 5 are not looked at."""
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return predict(rows, fit(rows, labels.where(fold_of(F.col("doc_id").cast("long"), 5) != 0), label_col))


def keep(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, that score `least` or more; one scan, no join back."""
    docs = small_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(fit(rows, labels.where(fold_of(F.col("doc_id").cast("long"), 5) != 0), label_col))

    def kept(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                s = votes(b.column(text_col).to_pylist(), known.value) if known.value else np.full(b.num_rows, 0.5)
                yield b.filter(pa.array(s >= least))
        hashes.clear()
        released()

    return docs.mapInArrow(kept, docs.schema)
