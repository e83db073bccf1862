"""Letter slots: every code point as one of 64 symbols, and counts of three symbols in a row."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLOTS = 64
GRAMS = SLOTS**3


@lru_cache(maxsize=1)
def slots() -> np.ndarray:
    """Slot of each code point: 0 what is no letter, 1-26 a to z (either case), 27-63 other letters, folded by a hash."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            x = ord(low[0])
            out[cp] = x - 96 if 97 <= x <= 122 else 27 + (x * 0x9E3779B1 >> 7) % 37
    return out


def codes(text: str) -> np.ndarray:
    """Codes of all three-symbol grams with a letter in them; the text is padded with a blank at each end."""
    raw = np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    s = slots()[raw].astype(np.int32)
    c = (s[:-2] * SLOTS + s[1:-1]) * SLOTS + s[2:]
    return c[c > 0]


def gram_rows(sums: dict, key: str) -> Iterator[pa.RecordBatch]:
    """The sums that a task gathered, as rows of key, gram and value."""
    for k, v in sums.items():
        at = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(v[at].astype(np.float64))], [key, "gram", "value"])
