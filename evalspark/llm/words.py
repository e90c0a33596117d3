"""Words, their hashes and rolling word n-gram hashes, vectorised over a batch of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from xxhash import xxh3_64_intdigest

GOLD = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Maximal runs without ASCII white space (bytes 09-0D and 20), as UTF-8; none for null."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def hashes(items: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, items), np.uint64, len(items))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_B
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, k: int, factor: np.uint64 = GOLD) -> np.ndarray:
    """A hash for each k consecutive values; empty when there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc *= factor
        acc += h[j : n + j]
    return mix(acc)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values, in log2(w) passes."""
    n = len(x) - w + 1
    if n <= 0:
        return np.empty(0, x.dtype)
    span, out = 1, x
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = w - span
    return np.minimum(out[:n], out[rest : n + rest]) if rest else out[:n]


def pieces(items: list, weight, most: int) -> Iterator[tuple[int, int]]:
    """Index ranges of ``items`` with a total weight of about ``most``; one item may exceed it."""
    begin = total = 0
    for i, x in enumerate(items):
        w = weight(x)
        if i > begin and total + w > most:
            yield begin, i
            begin, total = i, 0
        total += w
    if begin < len(items):
        yield begin, len(items)
