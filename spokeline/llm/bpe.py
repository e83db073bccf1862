"""Operator 10: byte-pair encoding and decoding, by tree concatenation for long unsplit text.

A text is cut into pre-tokens, which are merged by rank once and remembered. A pre-token's last symbol carries a word end, which no merge
goes across, so a text is one unsplit run of symbols. A text of more than `leaf_chars` characters is cut into halves at its middle
character, within a pre-token if that is where the middle is, and each half again, down to leaves; leaves are encoded by themselves, and
neighbours are then concatenated in a binary tree. At each join a window around the seam is encoded again and grown
until its first token is the left side's and its last token is the right side's. Each pair of adjacent
tokens of the result is then a pair that some direct encoding made, which is when a sequence is the encoding.
The halves of a text of more than `spread_chars` characters are rows of their own, encoded by many tasks, and joined by one.

Defined results: a null text is empty (no tokens); special tokens named in a text become their ids; rows that
repeat, doc_ids included, are encoded each; a null doc_id is kept; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, small_batches, written

#: Characters of a leaf of the tree, and of a stretch of a long text that is a row of its own.
LEAF_CHARS, SPREAD_CHARS = 2048, 32_768
#: Long texts, or stretches of them, that a task holds at a time; other texts sixteen times as many.
BLOCK = 8
#: Pre-tokens that a task remembers at most (about 300 bytes each).
REMEMBERED = 200_000
#: Texts of white space, ASCII and Latin letters alone are cut by a plain pattern that means the same as the vocabulary's there.
UNUSUAL = re.compile("[^\t-\r -~À-ÖØ-öø-įı-ſ]")
USUAL = re.compile("[a-zß-öø-ſ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\\sa-z0-9ß-öø-ſ]+")
#: Characters that str.split() takes for white space and the vocabulary's \s does not.
NOT_SPACE = regex.compile("[\x1c-\x1f]")
SCHEMA = "doc_id long, ids binary, n_tokens long, decoded string"


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    keep = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Words(dict):
    """pre-token -> (ids, decoded); when it is full, the younger half stays."""

    def __init__(self, bpe: "WordBpe"):
        super().__init__()
        self.bpe, self.old = bpe, {}

    def forget(self) -> None:
        """At the end of a task: workers live on, and other stages need their memory."""
        self.clear()
        self.old = {}
        released()

    def __missing__(self, word: str) -> tuple[bytes, str]:
        out = self.old.get(word) or self.bpe.packed([word] if word in self.bpe.special else self.bpe.merge(self.bpe.symbols(word)))
        if len(self) >= REMEMBERED // 2:
            self.old = dict(self)
            self.clear()
        self[word] = out
        return out


class WordBpe:
    """A BPE vocabulary with word ends, read from the text of a tokenizers JSON file."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        model = j["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.ids = self.vocab | self.special
        self.by_id = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        split = next(p for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"])
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = byte_letters()
        self.words = Words(self)

    # -- one pre-token -------------------------------------------------------------------------
    def symbols(self, word: str, last: bool = True) -> list[str]:
        if word.isascii() and word.isprintable():  # these stand for themselves
            out = list(word)
        else:
            out = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        if last and out:
            out[-1] += self.end
        return out

    def merge(self, parts: list[str]) -> list[str]:
        """Merge adjacent symbols, lowest rank first and leftmost among equals."""
        if len(parts) > 48:
            return self.merge_long(parts)
        get, none = self.ranks.get, 1 << 60
        near = [get(p, none) for p in zip(parts, parts[1:], strict=False)]  # rank of each adjacent pair
        while near and (best := min(near)) < none:
            i = near.index(best)
            whole = parts[i] + parts[i + 1]
            parts[i : i + 2] = [whole]
            del near[i]
            if i < len(near):
                near[i] = get((whole, parts[i + 1]), none)
            if i:
                near[i - 1] = get((parts[i - 1], whole), none)
        return parts

    def merge_long(self, parts: list[str]) -> list[str]:
        n, ranks = len(parts), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j] = a + b, False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return [p for p, x in zip(parts, alive, strict=True) if x]

    # -- joins ---------------------------------------------------------------------------------
    def base_symbols(self, tokens: list[str]) -> list[str]:
        out = []
        for t in tokens:
            if self.end and t.endswith(self.end) and len(t) > len(self.end):
                body = t[: -len(self.end)]
                out += [*body[:-1], body[-1] + self.end]
            else:
                out += t
        return out

    def join(self, left: list[str], right: list[str]) -> list[str]:
        """The encoding of two neighbours' text, from their encodings and a growing window around the seam."""
        if not left or not right:
            return left or right
        w = 2
        while True:
            a, b = max(0, len(left) - w), min(len(right), w)
            window = self.merge(self.base_symbols(left[a:] + right[:b]))
            if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[:a] + window + right[b:]
            w *= 2

    def concatenated(self, left: list[tuple[bytes, str]], right: list[tuple[bytes, str]]) -> list[tuple[bytes, str]]:
        """Two neighbours' entries (of a pre-token or a part of it each), joined at the seam."""
        if not left or not right:
            return left or right
        a, b = left[-1][1], right[0][1]
        if a in self.special or b in self.special:
            return left + right
        return [*left[:-1], self.packed(self.join(a.split(" "), b.split(" "))), *right[1:]]

    def halves(self, words: list[str]) -> tuple[list[str], list[str], bool]:
        """Pre-tokens cut at their middle character, and whether the cut is within a pre-token."""
        ends = list(accumulate(map(len, words)))
        k = bisect_left(ends, ends[-1] // 2)
        word = words[k]
        at = ends[-1] // 2 - ends[k] + len(word)
        if word in self.special or at in (0, len(word)):
            k = min(k + (at > 0), len(words) - 1) or 1
            return words[:k], words[k:], False
        return [*words[:k], word[:at]], [word[at:], *words[k + 1 :]], True

    def stretches(self, words: list[str], open_end: bool, most: int) -> list[tuple[list[str], bool]]:
        """The leaves of the tree over pre-tokens, in order: each with whether its last pre-token goes on in the next."""
        if len(words) < 2 and (not words or words[0] in self.special) or sum(map(len, words)) <= most:
            return [(words, open_end)]
        left, right, within = self.halves(words)
        return self.stretches(left, within, most) + self.stretches(right, open_end, most)

    def leaf(self, words: list[str], open_end: bool) -> list[tuple[bytes, str]]:
        out = list(map(self.words.__getitem__, words[:-1] if open_end else words))
        if open_end:
            out.append(self.packed(self.merge(self.symbols(words[-1], last=False))))
        return out

    def tree(self, leaves: list[list[tuple[bytes, str]]]) -> list[tuple[bytes, str]]:
        """Neighbours joined pair by pair, level by level."""
        while len(leaves) > 1:
            leaves = [self.concatenated(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else []

    def entries(self, words: list[str], open_end: bool, leaf_chars: int) -> list[tuple[bytes, str]]:
        return self.tree([self.leaf(*x) for x in self.stretches(words, open_end, leaf_chars)])

    # -- whole texts ---------------------------------------------------------------------------
    @staticmethod
    def normal(text: str) -> str:
        """Canonical composition and lower case, letter by letter (no word-final form of sigma)."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def packed(self, tokens: list[str]) -> tuple[bytes, str]:
        ids = array("I", [self.ids[t] for t in tokens])
        return ids.tobytes(), " ".join(tokens)

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """(special, piece): the text cut at special tokens."""
        if self.at_special is None or "<|" not in text:
            yield False, text
            return
        for i, piece in enumerate(self.at_special.split(text)):
            if piece:
                yield bool(i % 2), piece

    def cut(self, text: str) -> list[str]:
        text = self.normal(text)
        return regex.split(r"[^\S\x1c-\x1f]+", text) if NOT_SPACE.search(text) else text.split()

    def tokens_of(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if not UNUSUAL.search(text):
            return USUAL.findall(text.lower())
        return [w for c in self.cut(text) for w in self.split.findall(c)]

    def all_words(self, text: str) -> list[str]:
        """All pre-tokens of a text; special tokens stand as they are (no pre-token is written like one)."""
        out: list[str] = []
        for special, piece in self.pieces(text):
            out += [piece] if special else self.tokens_of(piece)
        return out

    def encode(self, text: str, leaf_chars: int = LEAF_CHARS) -> tuple[bytes, str]:
        words = self.all_words(text)
        got = self.entries(words, False, leaf_chars) if len(text) > leaf_chars else self.leaf(words, False)
        return b"".join([g[0] for g in got]), " ".join([g[1] for g in got])

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.by_id.__getitem__, array("I", ids)))


_loaded: dict[str, WordBpe] = {}


def loaded(spec: str, key: str) -> WordBpe:
    """The vocabulary, read once in each worker process."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBpe(spec)
    return _loaded[key]


def slices(batches: Iterator[pa.RecordBatch], rows: int = BLOCK) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from (b.slice(at, rows) for at in range(0, b.num_rows, rows))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS, spread_chars: int = SPREAD_CHARS, digest: bool = False) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), n_tokens and decoded of each row; with digest their sha256.

    vocabulary: path of the tokenizers JSON file on the driver; its text (a fixed file, under 2 MB) is broadcast.
    """
    spec = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())
    key = vocabulary
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else SCHEMA
    finish: Callable = _digest if digest else _whole

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value, key)
        for b in slices(batches, 16 * BLOCK):
            got = [bpe.encode(t, leaf_chars) for t in b.column("text").to_pylist()]
            yield finish(b.column("doc_id"), [g[0] for g in got], [g[1] for g in got])
        bpe.words.forget()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value, key)
        for b in slices(batches):
            for row, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                got = bpe.stretches(bpe.all_words(text), False, spread_chars)
                cols = [pa.array([row] * len(got), pa.int64()), pa.array([doc_id] * len(got), pa.int64()), pa.array(range(len(got)), pa.int32()), pa.array([g[0] for g in got], pa.list_(pa.string())), pa.array([g[1] for g in got])]
                yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "leaf", "words", "open_end"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value, key)
        for b in slices(batches):
            said = [[e[1] for e in bpe.entries(w, o, leaf_chars)] for w, o in zip(b.column("words").to_pylist(), b.column("open_end").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "doc_id", "leaf")), pa.array(said, pa.list_(pa.string()))], ["row", "doc_id", "leaf", "said"])
        bpe.words.forget()

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        """One text, which is one row of the result."""
        bpe = loaded(spec.value, key)
        pdf = pdf.sort_values("leaf")
        got = " ".join(e[1] for e in bpe.tree([[(b"", e) for e in said] for said in pdf["said"]]))
        doc_id = pdf["doc_id"].iloc[0]
        return finish(pa.array([None if pd.isna(doc_id) else int(doc_id)], pa.int64()), [bpe.packed(got.split(" ") if got else [])[0]], [got]).to_pandas()

    long = F.length("text") > spread_chars
    # rows are numbered before they are written, so that a task that runs again finds the same numbers
    leaves = written(rows.where(long).withColumn("row", F.monotonically_increasing_id()).mapInArrow(cut, "row long, doc_id long, leaf int, words array<string>, open_end boolean"))
    said = leaves.repartition("row", "leaf").mapInArrow(encoded, "row long, doc_id long, leaf int, said array<string>")
    return rows.where(~long).mapInArrow(alone, schema).unionByName(said.groupBy("row").applyInPandas(joined, schema))


def _whole(doc_ids, ids: list[bytes], said: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(said, pa.string())], ["doc_id", "ids", "n_tokens", "decoded"])


def _digest(doc_ids, ids: list[bytes], said: list[str]) -> pa.RecordBatch:
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return pa.RecordBatch.from_arrays([doc_ids, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x) for x in ids]), pa.array([sha(x.encode("utf-8", "surrogatepass")) for x in said])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
