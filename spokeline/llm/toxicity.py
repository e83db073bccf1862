"""Operator 1: toxicity by noisy-channel deobfuscation and scoring of the restored text.

A character model (three letters in a row, counted over all documents) is the source. The channel may write a letter
as a look-alike sign, repeat it, or put separators between letters. Each chunk that has a sign beside a letter, a letter written twice, or letters
with separators between them becomes a lattice of readings, whole, however long; the Viterbi path of least cost is its restored form, unless
it costs less that the chunk means what it says, as words and signs or as a code. The restored text is scored by terms (words and
word beginnings) that labelled texts show to be toxic: the log odds are a fitted offset plus the terms' log likelihood ratios, where
terms that clean texts have too count only beyond a density that is fitted on the sample. A term counts MOST_OF_A_WORD times in a text
at most, as further repeats of one word are no further evidence.

Defined results: null and empty texts have no terms and get the offset alone as their score; without toxic labels every score is near 0.
A doc_id that labels give twice is toxic if either says so. Readings of equal cost go to the one found first. Texts that repeat are learned once. Repeated rows are scored
each; other columns are not read. Whole texts are read in time that grows with their length, whatever runs of signs they hold; terms are learned from
MAX_LABELLED labelled rows at most.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, written
from .letters import GRAMS, SLOTS, codes, gram_rows, slots
from .quality import labelled_sample

# Signs and the letters that they may stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
SEPARATORS = " .-_*~'`^,/\\"
#: Costs (negative log probabilities) of the channel.
AS_IS, LOOKS_LIKE, REPEATED, DOUBLED, SEPARATED, DROPPED = 0.1, 1.0, 0.4, 6.0, 0.6, 9.0
#: Costs of what a chunk means if it stays unchanged: a sign among letters, a further one after it; a code, and each character of it.
PLAIN, PLAIN_ON, CODE, CODE_SIGN = 4.0, 2.3, 4.0, 3.6

_L = "[^\\W\\d_]"
_SIGN = "[" + re.escape("".join(LOOK_ALIKES)) + "]"
_ONE = "(?:[^\\W_]|" + _SIGN + ")"
#: Letters and signs one by one with blanks between them, as many as there are, anywhere in a text, also in brackets; what may follow such a row's last letter.
SPACED = re.compile(rf"""(?<![^\s("'\[{{<]){_ONE}(?: {_ONE}){{3,}}+""")
ROW_END = re.compile(r"""[.,;:!?"')\]}>]*+(?=\s|\Z)""")
LAST = re.compile(r"[^\W_]|[@$]")
#: Chunks without white space that may be obfuscated: signs beside letters, a letter three times (twice in a word of letters alone).
SUSPICIOUS = re.compile(rf"{_L}{_SIGN}|{_SIGN}{_L}|({_L})\1\1|^(?={_L}*({_L})\2){_L}+$")
#: What letters and signs by ones and twos are told apart by.
BY_ONES = frozenset(".-_*~'`^,/\\")
LETTER = re.compile(_L)
DOUBLE = re.compile(r"(.)\1")
TWO_LETTERS = re.compile(rf"{_L}.*{_L}", re.DOTALL)
#: Punctuation around a chunk: brackets and marks, and runs of three or more of a sign at its end.
OPENING, CLOSING = "(\"'[{<", ".,;:!?\"')]}>"
#: Labelled rows that terms are learned from, at most: those with the smallest hashes of doc_id.
MAX_LABELLED = 20_000
#: A term counts when so many toxic texts (and this share of them) have it, and with so much weight, a log likelihood ratio.
MIN_TOXIC, MIN_SHARE, MIN_WEIGHT, MAX_WEIGHT = 6, 0.004, 2.5, 5.0
#: A term that no clean text has and so many toxic ones is evidence by itself, however long a text is.
SURE_TOXIC = 30
#: Occurrences of one word that count.
MOST_OF_A_WORD = 3
REMEMBERED = 300_000


def edges(chunk: str) -> tuple[str, str, str]:
    """A chunk without the punctuation around it, and that: found from both ends, each sign looked at once."""
    core = chunk.lstrip(OPENING)
    lo, hi = len(chunk) - len(core), len(chunk)
    while hi > lo:
        c, at = chunk[hi - 1], hi - 1
        while at > lo and chunk[at - 1] == c:
            at -= 1
        if c not in CLOSING and (hi - at < 3 or c.isalnum() or c == "_"):
            break
        hi = at
    return chunk[:lo], chunk[lo:hi], chunk[hi:]


#: Without a group of one or two between two separators there are no three groups.
BETWEEN = re.compile(f"[{re.escape(''.join(sorted(BY_ONES)))}]{_ONE}{{1,2}}[{re.escape(''.join(sorted(BY_ONES)))}]")


def by_ones(core: str) -> bool:
    """Whether three or more groups of one or two letters and signs stand with separators between them and nothing else beside; all readings are followed at once."""
    if not BETWEEN.search(core):
        return False
    groups: set[tuple[int, int]] = set()  # (groups so far, three at most; signs in the last one, 0 after a separator)
    before = ""
    for c in core:
        one, letter = c.isalnum() or c in LOOK_ALIKES, c.isalnum()
        if not letter and any(n == 3 and k for n, k in groups):
            return True
        new = set()
        if c in BY_ONES:
            new = {(n, 0) for n, k in groups if k}
        if one:
            new |= {(n, 2) for n, k in groups if k == 1} | {(min(3, n + 1), 1) for n, k in groups if not k}
            if not before.isalnum():
                new.add((1, 1))
        groups, before = new, c
    return any(n == 3 and k for n, k in groups)


# -- source model ---------------------------------------------------------------------------------
def letter_model(rows: DataFrame) -> np.ndarray:
    """Costs of a letter after two others, from the grams of all documents (SLOTS^3 sums at most come back)."""

    def counted(batches):
        sums = np.zeros(GRAMS)
        for b in batches:
            for t in b.column("text").to_pylist():
                if t:
                    sums += np.bincount(codes(t), minlength=GRAMS) if len(t) > 20_000 else 0
                    if len(t) <= 20_000:
                        c, n = np.unique(codes(t), return_counts=True)
                        sums[c] += n
        yield from gram_rows({"": sums}, "key")

    counts = np.zeros(GRAMS)
    for gram, n in rows.select("text").mapInArrow(counted, "key string, gram int, value double").groupBy("gram").agg(F.sum("value")).collect():
        counts[gram] = n
    c = counts.reshape(SLOTS, SLOTS, SLOTS)
    two = c.sum(axis=0)  # the last two of three
    one = two.sum(axis=0)
    p1 = (one + 1) / (one.sum() + SLOTS)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (c + 5 * p2[None]) / (c.sum(axis=2, keepdims=True) + 5)
    return (-np.log(p3)).astype(np.float32)


def flat(cost: np.ndarray | list[float]) -> list[float]:
    """Costs as one list, which is quick to look up one by one: three slots in a row are at (first * SLOTS + second) * SLOTS + third."""
    return cost if isinstance(cost, list) else cost.ravel().tolist()


@lru_cache(maxsize=None)
def slot_of(ch: str) -> int:
    return int(slots()[ord(ch)])


@lru_cache(maxsize=None)
def readings(ch: str) -> list[tuple[str, float]]:
    """What a sign may stand for, with costs; an empty string drops it."""
    if ch in LOOK_ALIKES:
        return [(c, LOOKS_LIKE) for c in LOOK_ALIKES[ch]] + [("", SEPARATED if ch in SEPARATORS else DROPPED)]
    if ch.isalpha():
        return [(ch, AS_IS)]
    return [("", SEPARATED)]


@lru_cache(maxsize=None)
def ways_of(ch: str) -> list[tuple[str, float, int]]:
    """Readings with their slots."""
    return [(c, channel, slot_of(c) if c else 0) for c, channel in readings(ch)]


def viterbi(span: str, cost: np.ndarray | list[float]) -> str:
    """The reading of least cost of a span."""
    return best_reading(span, cost)[1]


def unchanged(span: str, cost: np.ndarray | list[float]) -> float:
    """The cost of a span that means what it says: its letters as words and its signs as signs, or all of it as a code."""
    cost = flat(cost)
    total, before, signs = 0.0, 0, 0  # before: place of the costs after the last two letters
    for ch in span:
        c = slot_of(ch)
        total += cost[before + c] if c or before % SLOTS**2 else 0.0
        total += AS_IS if c else PLAIN_ON if signs else PLAIN
        before, signs = (before % SLOTS**2 * SLOTS + c * SLOTS, 0) if c else (0, signs + 1)
    return min(total + (cost[before] if before % SLOTS**2 else 0.0), CODE + CODE_SIGN * len(span))


def best_reading(span: str, cost: np.ndarray | list[float]) -> tuple[float, str]:
    """Cost and text of the reading of least cost: states are the last two letters, edges the channel's readings."""
    cost = flat(cost)
    # a state has its cost, its text as a chain of letters (so that a step costs the same however long the span is), and the place of the costs after it
    states: dict[tuple[str, str], tuple[float, tuple | None, int]] = {("", ""): (0.0, None, 0)}
    letters = "".join(c for c in span if readings(c)[0][0])
    stretched = {m[1] for m in re.finditer(r"(.)\1\1", letters)}  # letters that are written three times in a row
    for ch in span:
        new: dict[tuple[str, str], tuple[float, tuple | None, int]] = {}
        again = REPEATED if ch in stretched else DOUBLED
        ways = ways_of(ch)
        for (a, b), (so_far, said, place) in states.items():
            for c, channel, sc in ways:
                if c:
                    total = so_far + channel + cost[place + sc]
                    if (b, c) not in new or total < new[b, c][0]:
                        new[b, c] = (total, (said, c), place % SLOTS**2 * SLOTS + sc * SLOTS)
                    if c != b:
                        continue
                    total = so_far + channel + again  # the same letter, written once more
                else:
                    total = so_far + channel
                if (a, b) not in new or total < new[a, b][0]:
                    new[a, b] = (total, said, place)
        states = new
    total, said = min(((total + cost[place], said) for total, said, place in states.values()), key=lambda x: x[0])
    out = []
    while said:
        said, c = said
        out.append(c)
    return total, "".join(reversed(out))


class Restorer:
    """Restores texts; remembers the chunks it has decoded."""

    def __init__(self, cost: np.ndarray):
        self.cost, self.known = flat(cost), {}

    def span(self, span: str) -> str:
        return viterbi(span, self.cost)

    def chunk(self, chunk: str) -> str:
        """A chunk without white space; signs around it that are mere punctuation stay."""
        out = self.known.get(chunk)
        if out is None:
            out = chunk
            if chunk.isalpha():  # of letters alone, those with one written twice are looked at
                head, core, tail = "", chunk, ""
                look = DOUBLE.search(core)
            else:
                head, core, tail = edges(chunk)
                look = LETTER.search(core) and (SUSPICIOUS.search(core) or by_ones(core))
            if len(core) > 2 and look:
                total, said = best_reading(core, self.cost)
                if total < unchanged(core, self.cost):
                    out = head + said + tail
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[chunk] = out
        return out

    def joined(self, text: str | None) -> str:
        """The lower-case text, with letters that stand one by one joined and decoded."""
        return SPACED.sub(self.row, text.lower()) if text else ""

    def row(self, m: re.Match) -> str:
        """A row of single signs, joined up to the last one that may end a word."""
        said, n = m[0], len(m[0]) - 1
        if not ROW_END.match(m.string, m.end()):
            n -= 2
        while n >= 6 and not LAST.match(said, n):
            n -= 2
        return self.span(said[: n + 1]) + said[n + 1 :] if n >= 6 and TWO_LETTERS.search(said, 0, n + 1) else said

    def restore(self, text: str | None) -> str:
        return re.sub(r"\S+", lambda m: self.chunk(m[0]), self.joined(text))


def restore(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and restored (the lower-case text with its obfuscated spans decoded) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cost = rows.sparkSession.sparkContext.broadcast(letter_model(rows))

    def restored(batches):
        r = Restorer(cost.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([r.restore(t) for t in b.column("text").to_pylist()], pa.string())], ["doc_id", "restored"])

    return rows.mapInArrow(restored, "doc_id long, restored string")


# -- terms ----------------------------------------------------------------------------------------
WORD = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[str]:
    """A word, and its beginnings of four to seven letters."""
    return [word, *("^" + word[:k] for k in range(4, min(8, len(word))))]


def learn_terms(sample: DataFrame, cost) -> tuple[dict[str, tuple[float, bool]], float]:
    """Toxic terms with weight and whether they are sure, counted over the cluster in distinct restored texts; and the prior."""

    def counted(batches):
        r = Restorer(cost.value)
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                seen[int(bool(label))].update({t for w in set(WORD.findall(r.restore(text))) for t in terms_of(w)} | {""})
            if sum(map(len, seen.values())) > 500_000:
                yield from flush(seen)
        yield from flush(seen)

    def flush(seen):
        for label, c in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([n * label for n in c.values()], pa.int64()), pa.array([n * (1 - label) for n in c.values()], pa.int64())], ["term", "toxic", "clean"])
            c.clear()

    got = sample.mapInArrow(counted, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    got = written(got.where(f"toxic >= {MIN_TOXIC} or term = ''"))
    whole = got.where("term = ''").first()
    if whole is None or not whole["toxic"]:
        return {}, -20.0
    toxic, clean = whole["toxic"], max(1, whole["clean"])
    weight = F.least(F.lit(MAX_WEIGHT), F.log((F.col("toxic") + 0.5) / toxic) - F.log((F.col("clean") + 0.5) / clean))
    best = got.where((F.col("term") != "") & (F.col("toxic") >= MIN_SHARE * toxic) & (weight >= MIN_WEIGHT)).select("term", weight.alias("w"), "toxic", "clean")
    best = best.collect()  # each is in MIN_SHARE of the toxic texts of a sample of MAX_LABELLED rows: a bounded number
    return {r["term"]: (r["w"], r["clean"] == 0 and r["toxic"] >= SURE_TOXIC) for r in best}, float(np.log(toxic / clean))


class Weights(dict):
    """chunk -> (weight, sure) of the best term of its restored words, or None."""

    def __init__(self, terms: dict[str, tuple[float, bool]], restorer: Restorer):
        super().__init__()
        self.restorer = restorer
        self.words = {t: w for t, w in terms.items() if t[:1] != "^"}
        self.beginnings = {t[1:]: w for t, w in terms.items() if t[:1] == "^"}

    def __missing__(self, chunk: str) -> tuple[float, bool] | None:
        if len(self) >= REMEMBERED:
            self.clear()
        found = []
        for w in WORD.findall(self.restorer.chunk(chunk)):
            if w in self.words:
                found.append(self.words[w])
            for k in range(4, min(8, len(w))):
                if w[:k] in self.beginnings:
                    found.append(self.beginnings[w[:k]])
        out = self[chunk] = max(found, key=lambda x: (x[1], x[0]), default=None)
        return out

    def evidence(self, text: str | None) -> tuple[float, float, int]:
        """Of a whole text: weight of sure terms, weight of the others, number of words."""
        chunks = self.restorer.joined(text).split()
        sums = [0.0, 0.0]
        for chunk, n in Counter(filter(self.__getitem__, chunks)).items():
            w, sure = self[chunk]
            sums[not sure] += w * min(n, MOST_OF_A_WORD)
        return sums[0], sums[1], len(chunks)


def scores(sure, others, words, prior: float, density: float):
    """Terms that clean texts have now and then must be denser than chance makes them."""
    x = prior + np.asarray(sure) + np.maximum(0, np.asarray(others) - density * np.asarray(words))
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_density(sample: DataFrame, cost, terms, prior: float) -> tuple[float, float]:
    """The density, and the log odds of a text without terms (the prior at most), of least loss on the labelled sample (three numbers a text)."""

    def measured(batches):
        w = Weights(terms.value, Restorer(cost.value))
        for b in batches:
            got = np.array([w.evidence(t) for t in b.column("text").to_pylist()], np.float64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*map(pa.array, got.T.copy()), b.column("label")], ["sure", "others", "words", "label"])

    got = sample.mapInArrow(measured, "sure double, others double, words double, label int").toPandas()
    y = got["label"].to_numpy() > 0

    def loss(fit: tuple[float, float]) -> float:
        s = scores(got["sure"], got["others"], got["words"], fit[1], fit[0]).clip(1e-6, 1 - 1e-6)
        return float(-np.log(np.where(y, s, 1 - s)).sum())

    return min(((k / 500, min(prior, 0.0) - j / 4) for k in range(0, 51, 2) for j in range(21)), key=loss)


def predict(rows: DataFrame, cost, terms: dict[str, tuple[float, bool]], prior: float, density: float) -> DataFrame:
    known = rows.sparkSession.sparkContext.broadcast(terms)  # bounded by the sample, see learn_terms

    def scored(batches):
        w = Weights(known.value, Restorer(cost.value))
        for b in batches:
            s = scores(*np.array([w.evidence(t) for t in b.column("text").to_pylist()], np.float64).reshape(-1, 3).T, prior, density)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.3).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = rows.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row; labels of fold 2 of 4 are not looked at."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cost = rows.sparkSession.sparkContext.broadcast(letter_model(rows))  # SLOTS^3 floats
    sample = labelled_sample(rows, labels.where(fold_of(F.col("doc_id").cast("long"), 4) != 2), label_col, MAX_LABELLED)
    sample = written(sample.groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.max("text").alias("text"), F.max("label").alias("label")).select("text", "label"))
    terms, prior = learn_terms(sample, cost)
    density, prior = fit_density(sample, cost, rows.sparkSession.sparkContext.broadcast(terms), prior) if terms else (0.0, -20.0)
    return predict(rows, cost, terms, prior, density)
