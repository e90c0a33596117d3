"""Terms of lexical search and decontamination, and a filter of bounded size for hashes."""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .words import pieces

#: ASCII letters in lower case, digits and all bytes of other characters stay; the rest separates.
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of letters, digits and non-ASCII characters, only A-Z lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_KEPT).split() if text else []


def hashes(items: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, items, repeat(seed)), np.uint64, len(items))


def hashed_terms(texts: list[str | None], seed: int = 0, most: int = 1 << 22):
    """For groups of texts of bounded length: their first index, each one's terms, and all term hashes in a row."""
    for begin, end in pieces(texts, lambda t: len(t or ""), most):
        split = [terms(t) for t in texts[begin:end]]
        yield begin, split, hashes([w for s in split for w in s], seed)


def bit_filter(hashed: DataFrame, most: int = 26) -> np.ndarray:
    """A Bloom filter of ``hashed(h long)``, two bits a value, of 2 ** ``most`` bits at most.

    Beyond some millions of values it lets more others pass; it never loses one.
    """
    bits = min(most, max(12, int(32 * hashed.count()).bit_length()))
    mask = F.lit((1 << bits) - 1)
    both = F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask))
    at = hashed.select(F.explode(both).alias("at"))
    rows = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("held")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("held").to_numpy().view(np.uint64)
    return out


def passes(held: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes the filter lets pass."""
    bits = len(held).bit_length() + 5
    mask = np.uint64((1 << bits) - 1)
    out = np.ones(len(h), bool)
    for at in (h & mask, (h >> np.uint64(32)) & mask):
        out &= ((held[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
    return out
