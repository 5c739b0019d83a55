"""Shingle sets and one-permutation sketches of texts, computed on Arrow batches."""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(33))) * _MIX[1]
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text, A-Z lower-cased, split at ASCII white
    space. A text of fewer words, but not none, is one shingle."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    size = min(words, len(tokens))
    last = len(tokens) - size + 1
    rolled = hashes[:last]
    for k in range(1, size):
        rolled = mixed(rolled * _ODD + hashes[k : k + last])
    return np.unique(mixed(rolled + np.uint64(size)))


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits of a whole set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


@cache
def _donors(bins: int, block: int) -> np.ndarray:
    """For every bin 64 further bins to borrow from, the same for all texts."""
    tries = np.arange(64, dtype=np.uint64) + np.uint64(64 * block)
    seeds = np.arange(bins, dtype=np.uint64)[:, None] * _ODD + tries[None, :] * _MIX[0] + np.uint64(1)
    return (mixed(mixed(seeds)) % np.uint64(bins)).astype(np.int64)


def one_permutation(shingles: np.ndarray, bins: int) -> np.ndarray:
    """The smallest hash of each bin under one permutation; an empty bin borrows from the first non-empty
    one in its own random order (optimal densification)."""
    place = (((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(place), bool)
    first[1:] = place[1:] != place[:-1]  # the set is sorted, so a bin's first hash is its smallest
    sketch = np.zeros(bins, np.uint64)
    held = np.zeros(bins, bool)
    sketch[place[first]] = shingles[first]
    held[place[first]] = True
    empty, block = np.flatnonzero(~held), 0
    while len(empty):
        donors = _donors(bins, block)[empty]
        usable = held[donors]
        found = usable.any(axis=1)
        sketch[empty[found]] = sketch[donors[found, usable[found].argmax(axis=1)]]
        empty, block = empty[~found], block + 1
    return sketch


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key for each band of each sketch."""
    parts = sketches[:, : bands * rows].reshape(len(sketches), bands, rows)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _ODD, parts.shape[:2])
    for k in range(rows):
        keys = mixed(keys * _ODD + parts[:, :, k])
    return keys.view(np.int64)
