"""Suffix order of an integer text by the difference cover {1, 2} modulo 3, in whole arrays."""

from __future__ import annotations

import numpy as np

#: Three symbols, or two and a rank, share one 64-bit key.
SYMBOL_BITS = 21
MAX_TEXT = (1 << SYMBOL_BITS) - 8


def _small(t: np.ndarray) -> np.ndarray:
    """By doubling, for short texts."""
    n = len(t)
    rank, k = np.unique(t, return_inverse=True)[1].astype(np.int64) + 1, 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        if k < n:
            second[:-k] = rank[k:]
        key = rank * (n + 2) + second
        _, new = np.unique(key, return_inverse=True)
        rank, k = new.astype(np.int64) + 1, k * 2
        if rank.max() == n or k >= 2 * n:
            return np.argsort(rank, kind="stable")


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order; symbols are at least 1 and under 2**21, a text's end sorts before every symbol."""
    n = len(t)
    if n > MAX_TEXT:
        raise ValueError(f"at most {MAX_TEXT} symbols")
    if n < 256:
        return _small(t) if n > 1 else np.arange(n)
    b = np.int64(SYMBOL_BITS)
    pad = np.concatenate([t.astype(np.int64), np.zeros(4, np.int64)])
    # the sample: positions 1 and 2 modulo 3, with an empty one at the end that keeps the two halves apart
    s1, s2 = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([s1, s2])
    triple = pad[sample] << (2 * b) | pad[sample + 1] << b | pad[sample + 2]
    names, inverse = np.unique(triple, return_inverse=True)
    if len(names) < len(sample):
        order = suffix_array(inverse + 1)  # recurse on the names
    else:
        order = np.argsort(inverse)
    s12 = sample[order]
    rank = np.zeros(n + 5, dtype=np.int64)
    rank[s12] = np.arange(1, len(s12) + 1)
    s12 = s12[s12 < n]
    # the rest, by one symbol and the rank of what follows
    s0 = np.arange(0, n, 3)
    k0 = pad[s0] << b | rank[s0 + 1]
    o = np.argsort(k0)
    s0, k0 = s0[o], k0[o]
    # merge: how many sampled suffixes stand before each of the rest
    a1, a2 = s12[s12 % 3 == 1], s12[s12 % 3 == 2]
    before = np.searchsorted(pad[a1] << b | rank[a1 + 1], k0)
    k0 = pad[s0] << (2 * b) | pad[s0 + 1] << b | rank[s0 + 2]
    before += np.searchsorted(pad[a2] << (2 * b) | pad[a2 + 1] << b | rank[a2 + 2], k0)
    out = np.empty(n, dtype=np.int64)
    place = np.arange(len(s0)) + before
    rest = np.ones(n, dtype=bool)
    rest[place] = False
    out[place], out[rest] = s0, s12
    return out


def equal_neighbours(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For starts in suffix order: is the string of ``length`` bytes the same as that of the start before?"""
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), dtype="<u8", buffer=raw.data, strides=(1,))
    same = np.ones(len(starts), dtype=bool)
    same[:1] = False
    a, b = starts[:-1], starts[1:]
    offsets = [*range(0, length - 7, 8), *([length - 8] if length % 8 and length >= 8 else [])] if length >= 8 else []
    for k in offsets:
        same[1:] &= words[a + k] == words[b + k]
    if length < 8:
        for k in range(length):
            same[1:] &= data[a + k] == data[b + k]
    return same
