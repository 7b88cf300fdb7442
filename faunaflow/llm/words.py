"""Hashes of words and of word windows, over whole batches of texts at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd

#: Odd, so it has an inverse modulo 2^64 and a window's sum does not depend on where it starts.
MULTIPLIER = 0x9E3779B97F4A7C15
#: For a second, independent hash.
SECOND = 0xD6E8FEB86659FD93
#: Words hashed at once; bounds memory, not results.
CHUNK = 50_000


def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, dtype=np.uint64)])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(words: np.ndarray, width: int, multiplier: int = MULTIPLIER) -> np.ndarray:
    """A signed 64-bit hash for each window of that many word hashes."""
    if len(words) < width:
        return np.empty(0, dtype=np.int64)
    up = powers(multiplier, len(words))
    down = powers(pow(multiplier, -1, 1 << 64), len(words))
    sums = np.r_[np.uint64(0), np.cumsum(words * up[: len(words)])]
    n = len(words) - width + 1
    return mix((sums[width:] - sums[:n]) * down[:n] + np.uint64(width)).view(np.int64)


def word_hashes(texts: Iterable[bytes]) -> Iterator[list[np.ndarray]]:
    """The hashes of each text's words, between ASCII white space, in lists of some texts at a time."""
    words: list[bytes] = []
    ends: list[int] = []
    for text in texts:
        words += text.split()
        ends.append(len(words))
        if len(words) >= CHUNK:
            yield _hashed(words, ends)
            words, ends = [], []
    if ends:
        yield _hashed(words, ends)


def _hashed(words: list[bytes], ends: list[int]) -> list[np.ndarray]:
    each = np.empty(len(words), dtype=object)
    each[:] = words
    return np.split(pd.util.hash_array(each, categorize=False), ends[:-1])
