"""Operator 6: language identification with hyperdimensional profiles.

Each letter slot has a random vector of +1 and -1. A gram of three symbols is bound into one vector: the first
letter's vector rotated twice, times the second's rotated once, times the third's. A text's vector bundles (adds) its
gram vectors; a language's prototype bundles those of its training texts, each text with the same weight. A text
gets the language whose prototype is nearest by cosine.

keep() drops texts that look like no learned language. How near a text is to its language grows with its length, so the least cosine is learned
by length: of the training texts of each power of two of letter grams a low quantile, less a margin.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every text when nothing could be
learned. A text whose grams bind to a zero sum is nearest to the first language, with score 0. Ties go to the language first in order. Texts are
counted whole, however long. Repeated rows are predicted each; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of, released, small_batches
from .letters import GRAMS, SLOTS, codes

DIMS = 1024
SEED = 20_240_607
#: Texts that are bundled by one matrix product.
BLOCK = 96


@lru_cache(maxsize=1)
def letter_vectors() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), size=(SLOTS, DIMS))


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    v = letter_vectors()
    first, second = np.roll(v, 2, axis=1), np.roll(v, 1, axis=1)
    return (first[grams // SLOTS**2] * second[grams // SLOTS % SLOTS] * v[grams % SLOTS]).astype(np.float32)


def bundles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """One vector of DIMS for each text, zero for those without a letter; and its number of grams."""
    each = [codes(t) if t else np.empty(0, np.int32) for t in texts]
    flat = np.concatenate(each)
    grams = np.flatnonzero(np.bincount(flat, minlength=GRAMS))
    place = np.zeros(GRAMS, np.int64)
    place[grams] = np.arange(len(grams))
    row = np.repeat(np.arange(len(each)), [len(c) for c in each])
    counts = np.bincount(row * len(grams) + place[flat], minlength=len(each) * len(grams)).reshape(len(each), len(grams)).astype(np.float32)
    out = np.zeros((len(each), DIMS), np.float32)
    for at in range(0, len(grams), 4096):
        out += counts[:, at : at + 4096] @ gram_vectors(grams[at : at + 4096])
    return out, np.array([len(c) for c in each])


def prototypes(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Unit prototypes of the languages of the rows where `learn` holds: bundles of their texts, DIMS numbers of each, summed over the cluster."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def summed(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                for lang, v, n in zip(b.column("lang").to_pylist(), *bundles(b.column("text").to_pylist()), strict=True):
                    if n:
                        sums[lang] = sums.get(lang, 0) + v / np.float64(n)
            if len(sums) > 1000:
                yield from rows_of(sums)
                sums = {}
        yield from rows_of(sums)
        released()

    def rows_of(sums):
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMS, pa.string()), pa.array(np.arange(DIMS, dtype=np.int32)), pa.array(v)], ["lang", "dim", "value"])

    found = rows.mapInArrow(summed, "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value")).toPandas()  # DIMS numbers a language
    out = {}
    for lang, part in sorted(found.groupby("lang"), key=lambda x: x[0]):
        v = np.zeros(DIMS)
        v[part["dim"]] = part["value"]
        out[lang] = (v / max(np.linalg.norm(v), 1e-30)).astype(np.float32)
    return out


def nearest(texts: list[str | None], protos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: the number of its nearest prototype, the cosine (0 at least), and how many grams it has."""
    v, n = bundles(texts)
    if not len(protos):
        return np.zeros(len(v), int), np.zeros(len(v)), n * 0
    cos = (v @ protos.T) / np.maximum(np.linalg.norm(v, axis=1), 1e-30)[:, None]
    best = cos.argmax(axis=1)
    return best, np.clip(cos[np.arange(len(best)), best].astype(np.float64), 0, 1), n


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score (the cosine, 0 at least) of every row."""
    langs = list(profiles)
    known = docs.sparkSession.sparkContext.broadcast(np.stack([profiles[k] for k in langs]) if langs else np.zeros((0, DIMS), np.float32))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold_of(F.col(id_col), 4) == 2).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def predicted(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                best, score, n = nearest(b.column("text").to_pylist(), known.value)
                said = [langs[k] if grams else "und" for k, grams in zip(best, n, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(said, pa.string()), pa.array(np.where(n > 0, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(predicted, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows outside fold 2 of 4 and predict all rows."""
    docs = small_batches(docs)
    return predict(docs, prototypes(docs, fold_of(F.col(id_col), 4) != 2, text_col, lang_col), id_col, text_col)


#: Of the training texts of a length, the share that may be below the least cosine, and the part of that quantile that is asked for.
QUANTILE, MARGIN = 0.002, 0.7
#: Cosines are counted in steps of one in so many.
STEPS = 1000


def least_cosines(docs: DataFrame, learn: Column, protos: np.ndarray, text_col: str = "text", lang_col: str = "lang") -> np.ndarray:
    """For texts of 2^k grams and more, k from 0 to 63: the least cosine of a text that looks like a learned language."""
    known = docs.sparkSession.sparkContext.broadcast(protos)
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"))

    def counted(batches):
        counts = np.zeros((64, STEPS + 1), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                _, score, n = nearest(batch.slice(at, BLOCK).column("text").to_pylist(), known.value)
                np.add.at(counts, (np.log2(np.maximum(n, 1)).astype(int)[n > 0], (score[n > 0] * STEPS).astype(int)), 1)
        k, step = np.nonzero(counts)
        released()
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(step.astype(np.int32)), pa.array(counts[k, step])], ["k", "step", "n"])

    counts = np.zeros((64, STEPS + 1))
    for k, step, n in rows.mapInArrow(counted, "k int, step int, n long").groupBy("k", "step").agg(F.sum("n")).collect():  # 64 lengths, STEPS + 1 steps
        counts[k, step] = n
    out = np.full(64, np.nan)
    for k in range(64):
        if counts[k].sum():
            out[k] = MARGIN * np.searchsorted(np.cumsum(counts[k]), QUANTILE * counts[k].sum()) / STEPS
    # lengths without training texts: as the next shorter one that has some, else the shortest
    seen = np.flatnonzero(~np.isnan(out))
    return np.array([out[seen[max(0, np.searchsorted(seen, k, side="right") - 1)]] if len(seen) else 0.0 for k in range(64)])


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, all columns, whose text is in some learned language: not `und`, and as near to it as texts of its length are."""
    docs = small_batches(docs)
    learn = fold_of(F.col(id_col), 4) != 2
    profiles = prototypes(docs, learn, text_col, lang_col)
    protos = np.stack([profiles[k] for k in profiles]) if profiles else np.zeros((0, DIMS), np.float32)
    known = docs.sparkSession.sparkContext.broadcast((protos, least_cosines(docs, learn, protos, text_col, lang_col)))

    def kept(batches):
        protos, least = known.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                _, score, n = nearest(b.column(text_col).to_pylist(), protos)
                yield b.filter(pa.array((n > 0) & (score >= least[np.log2(np.maximum(n, 1)).astype(int)])))
        released()

    return docs.mapInArrow(kept, docs.schema)
