"""Words of whole texts as 64-bit hashes, and hashes of runs of words, in plain array operations."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

from ._common import frees
from .tokenize import Cache

_known = Cache(xxhash.xxh3_64_intdigest, 200_000)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


@frees("words")
def forget() -> None:
    """Frees the worker's cache of word hashes."""
    _known.clear()


def split_words(text: str) -> list[bytes]:
    """Runs of anything but space and 09-0D, A-Z lower-cased."""
    return text.encode().lower().split()


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words in turn, and each text's number of words."""
    split = [split_words(t) for t in texts]
    counts = np.array([len(x) for x in split], dtype=np.int64)
    return np.fromiter(map(_known.__getitem__, chain.from_iterable(split)), np.uint64, int(counts.sum())), counts


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive words."""
    size = max(0, len(hashes) - n + 1)
    out = np.full(size, n, dtype=np.uint64)
    for j in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + size])
    return out


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """The distinct n-word shingles, sorted; of fewer words, the whole row as one; of none, none."""
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64)
    return np.unique(runs(hashes, min(n, len(hashes))))
