"""Word shingles of whole texts as 64-bit hashes, and SuperMinHash signatures of their sets, in numpy.

Words are runs of bytes other than space and 09-0D of the text with A-Z lowered. A word's hash comes from running
sums over the bytes of many texts at once, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Bytes of text that are hashed at once (a longer text alone).
CHUNK = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte (the same for both cases of a letter), and which bytes part words."""
    of = np.arange(256)
    of[65:91] += 32
    parts = np.zeros(256, bool)
    parts[[9, 10, 11, 12, 13, 32]] = True
    return mix((of + 1).astype(np.uint64) * _U(0xD6E8FEB86659FD93)), parts


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        x = np.full(n, base, np.uint64)
        x[0] = 1
        return np.cumprod(x, dtype=np.uint64)

    return of(_BASE), of(_INVERSE)


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``k``-word shingles.

    A text of fewer words has its whole sequence as its one shingle; one without words (or null) has none.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    lo = 0
    while lo < len(raw):
        hi, size = lo + 1, len(raw[lo])
        while hi < len(raw) and size + len(raw[hi]) < CHUNK:
            size += len(raw[hi])
            hi += 1
        yield from _sets(raw[lo:hi], k)
        lo = hi


def _sets(raw: list[bytes], k: int) -> Iterator[np.ndarray]:
    values, parts = _bytes()
    text = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    n = len(text)
    up, down = _powers(1 << max(CHUNK + 4096, n).bit_length())
    between = parts[text]
    starts = np.flatnonzero(between[:-1] & ~between[1:]) + 1
    ends = np.flatnonzero(~between[:-1] & between[1:]) + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[text] * up[:n], dtype=np.uint64)])
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))
    # where each text's words begin
    at = np.cumsum([1, *(len(r) + 1 for r in raw)])
    first = np.searchsorted(starts, at)
    shingles = words.copy()
    for j in range(1, k):
        shingles = mix(shingles[: max(0, len(words) - j)] * _U(0x9FB21C651E98DF25) + words[j:] + _U(j))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(shingles[a : b - k + 1])
        elif b > a:
            whole = words[a : a + 1]
            for j in range(1, b - a):
                whole = mix(whole * _U(0x9FB21C651E98DF25) + words[a + j : a + j + 1] + _U(j))
            yield mix(whole ^ _U(b - a + (1 << 32)))
        else:
            yield np.zeros(0, np.uint64)


def set_keys(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128 bits that tell sets apart, two columns; elements are those of all sets in a row, none of them empty."""
    starts = np.cumsum(sizes) - sizes
    return np.stack([np.add.reduceat(mix(elements ^ _U(seed)), starts) + sizes.astype(np.uint64) for seed in (0x51ED270B, 0xA24BAED4)], axis=1)


def super_minhash(elements: np.ndarray, sizes: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures, ``m`` (256 at most) values for each set; sets as in ``set_keys``.

    An element deals the ranks 0, 1, ... to the places by a random permutation of its own and adds a random
    fraction to each; a place keeps its smallest value. Round j deals rank j; a set leaves once its largest value
    is below the next rank, as further ranks change nothing.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    best = np.full(len(sizes) * m, np.inf)
    perm = np.empty((len(elements), m), np.uint8)
    perm[:] = np.arange(m, dtype=np.uint8)
    rows = np.arange(len(elements))
    open_ = np.ones(len(sizes), bool)
    for j in range(m):
        x = mix(elements[rows] + _U((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        y = mix(x ^ _U(0x2545F4914F6CDD1D))
        k = j + ((y >> _U(32)) * _U(m - j) >> _U(32)).astype(np.int64)
        place = perm[rows, k]
        perm[rows, k] = perm[rows, j]
        np.minimum.at(best, owner[rows] * m + place, (x >> _U(11)).astype(np.float64) * 2.0**-53 + j)
        open_ &= best.reshape(-1, m).max(axis=1) >= j + 1
        rows = rows[open_[owner[rows]]]
        if not len(rows):
            break
    return best.reshape(-1, m)


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    n, m = signatures.shape
    x = np.ascontiguousarray(signatures).view(np.uint64).reshape(n, bands, m // bands)
    key = mix(np.arange(1, bands + 1, dtype=np.uint64) * _U(0xD1B54A32D192ED03))[None, :].repeat(n, axis=0)
    for i in range(m // bands):
        key = mix(key * _U(0x9FB21C651E98DF25) + x[:, :, i])
    return key
