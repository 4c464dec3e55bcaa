"""Parity sketches: a few bytes of a set that tell of most pairs that they can't be alike, and never of one that is.

Bit i is the parity of how many elements fall on slot i. In the exclusive-or of two sketches what both sets have cancels out, so it has at most
as many ones as there are elements in one set only. Sets of n and m elements whose Jaccard similarity is least or more have (1 - least) / (1 + least) * (n + m) of those at most.
A sketch has more bits than its set has elements, up to MOST_BITS; folded, a long one compares with a short one.
"""

from __future__ import annotations

import numpy as np

LEAST_BITS, MOST_BITS = 64, 8192


def sketch(s: np.ndarray) -> bytes:
    """Of a set of hashes."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << len(s).bit_length()))
    return np.packbits((np.bincount((s % s.dtype.type(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(x: bytes, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, size), axis=0).view(np.uint64)


def may_be_alike(sketches: list[bytes], sizes: np.ndarray, least: float) -> np.ndarray:
    """Matrix of which of some sets may be alike."""
    words = np.stack([_folded(x, min(map(len, sketches))) for x in sketches])
    apart = np.zeros((len(words), len(words)), np.uint16)
    for w in words.T:
        apart += np.bitwise_count(w[:, None] ^ w)
    n, m = sizes[:, None].astype(np.float64), sizes.astype(np.float64)
    return (apart <= (n + m) * ((1 - least) / (1 + least)) + 1e-6) & (np.minimum(n, m) >= least * np.maximum(n, m))


def pair_may_be_alike(x: bytes, n: int, y: bytes, m: int, least: float) -> bool:
    if min(n, m) < least * max(n, m):
        return False
    size = min(len(x), len(y))
    return int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()) <= (n + m) * ((1 - least) / (1 + least)) + 1e-6
