"""Vectorised hashing kernels over the words of one text (numpy, mod 2**64)."""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
BASE_A = 0x9E3779B97F4A7C15
BASE_B = 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1
#: Words of a text up to which powers are kept from text to text.
KEPT = 1 << 16
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (splitmix64's last steps)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=U64, count=len(words))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n; an odd base has an inverse mod 2**64. Short tables are kept, 512 KB each."""
    got = _tables.get(base)
    if got is None or len(got[0]) < n:
        size = max(KEPT, n)
        up, down = np.full(size, base, dtype=U64), np.full(size, pow(base, -1, 1 << 64), dtype=U64)
        up[0] = down[0] = 1
        got = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        if size == KEPT:
            _tables[base] = got
    return got[0][:n], got[1][:n]


def window_hashes(hashes: np.ndarray, width: int, base: int = BASE_A) -> np.ndarray:
    """Rabin-Karp hash of every ``width`` consecutive hashes, by prefix sums.

    Returns ``len - width + 1`` values, none if the sequence is shorter.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    up, down = _powers(base, len(hashes))
    sums = np.zeros(len(hashes) + 1, dtype=U64)
    np.cumsum(hashes * up, dtype=U64, out=sums[1:])
    return mix((sums[width:] - sums[:n]) * down[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    n, have = len(values) - width + 1, 1
    if n <= 0:
        return np.empty(0, dtype=values.dtype)
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[: len(values) - step], values[step:])
        have += step
    return values[:n]


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; a shorter text is one shingle."""
    if not words:
        return np.empty(0, dtype=U64)
    return np.unique(window_hashes(word_hashes(words), min(width, len(words))))


def set_digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits that name a sorted set, as two signed longs."""
    d = xxhash.xxh3_128_intdigest(values.tobytes())
    return signed(d & _MASK), signed(d >> 64)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def one_permutation(values: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash of a sorted, non-empty set, optimally densified.

    The hash space is cut into ``bins`` equal ranges and a bin keeps its smallest hash.
    An empty bin copies a non-empty one that a hash of (bin, attempt) picks, the same for
    every set, so that a copied bin agrees with probability J as a full one does.
    """
    edges = (np.arange(bins, dtype=object) * (1 << 64) // bins).astype(U64)
    first = np.searchsorted(values, edges)
    last = np.append(first[1:], len(values))
    full = first < last
    out = values[np.minimum(first, len(values) - 1)]
    empty, attempt = np.flatnonzero(~full), 0
    while len(empty):
        attempt += 1
        pick = mix(empty.astype(U64) * U64(BASE_A) + U64(attempt * BASE_B & _MASK)) % U64(bins)
        ok = full[pick]
        out[empty[ok]] = out[pick[ok]]
        empty = empty[~ok]
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` signature values; the band's number is part of it."""
    parts = signature.reshape(-1, rows)
    key = np.arange(1, len(parts) + 1, dtype=U64) * U64(BASE_B)
    for j in range(rows):
        key = mix(key * U64(BASE_A) + parts[:, j])
    return key.view(np.int64)
