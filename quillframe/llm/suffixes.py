"""Suffix order by difference cover, in numpy, to a limited depth.

``ranks`` sorts the suffixes at positions that are 1 or 2 modulo 3 by their triples, names the
triples, recurses on the string of names, and merges the remaining suffixes in. Suffixes that
agree in their first ``depth`` symbols may share a rank; all others are in order. One level of
recursion reads a third of the depth, so it ends once a triple of names covers what is left.
"""

from __future__ import annotations

import numpy as np


def _names(t: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Ranks from 1 of the triples of t that begin at these places, equal for equal triples; symbols lie below size."""
    key = t[at].astype(np.int64)
    key *= size
    key += t[at + 1]
    if size**3 >= 1 << 62:
        key = _dense(key).astype(np.int64)
    key *= size
    key += t[at + 2]
    if size**3 <= 1 << 25:
        seen = np.zeros(size**3, bool)
        seen[key] = True
        return np.cumsum(seen, dtype=np.int32)[key]
    return _dense(key)


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    found = key[order]
    new = np.ones(len(key), bool)
    new[1:] = found[1:] != found[:-1]
    out = np.empty(len(key), np.int32)
    out[order] = np.cumsum(new, dtype=np.int32)
    return out


def ranks(s: np.ndarray, size: int, depth: int) -> np.ndarray:
    """A rank for each suffix of s, whose symbols lie in [1, size). Symbols and ranks have 32 bits, so s has fewer than 2**31 of them."""
    n = len(s)
    if n < 3:
        order = sorted(range(n), key=lambda i: s[i:].tolist())
        out = np.empty(n, np.int64)
        out[order] = np.arange(1, n + 1)
        return out
    t = np.zeros(n + 4, np.int32)
    t[:n] = s
    # One sample more than needed where n is 1 modulo 3: its triple of padding ends the first half.
    samples = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    names = _names(t, samples, size)
    top = int(names.max())
    if depth > 3 and top < len(samples):
        names = ranks(names, top + 1, -(-depth // 3) + 1)
    rank = np.zeros(n + 4, np.int32)
    rank[samples] = names
    del names
    # The rest: by first symbol, then by the rank of the sampled suffix after it.
    wide = int(rank.max()) + 1
    zero = np.arange(0, n, 3)
    key = t[zero].astype(np.int64) * wide + rank[zero + 1]
    by_zero = np.argsort(key, kind="stable")
    zero, key = zero[by_zero], key[by_zero]
    # Merge. Samples at 1 modulo 3 compare with the rest by one symbol and a rank, the others by two.
    samples = samples[samples < n]
    samples = samples[np.argsort(rank[samples], kind="stable")]
    one, two = samples[samples % 3 == 1], samples[samples % 3 == 2]
    before = np.searchsorted(t[one].astype(np.int64) * wide + rank[one + 1], key)
    del key
    pairs = [t[two].astype(np.int64) * size + t[two + 1], t[zero].astype(np.int64) * size + t[zero + 1]]
    if size * size * wide >= 1 << 62:
        both = _dense(np.concatenate(pairs)).astype(np.int64)
        pairs = [both[: len(two)], both[len(two) :]]
    before += np.searchsorted(pairs[0] * wide + rank[two + 2], pairs[1] * wide + rank[zero + 2])
    # Equal up to the depth, the two comparisons may disagree; any order will do there.
    before = np.maximum.accumulate(before)
    del pairs
    out = np.empty(n, np.int32)
    out[zero] = np.arange(1, len(zero) + 1) + before
    out[samples] = np.arange(1, len(samples) + 1) + np.searchsorted(before, np.arange(len(samples)), side="right")
    return out


def order(s: np.ndarray, size: int, depth: int) -> np.ndarray:
    """Suffix array: positions in suffix order, right in the first depth symbols."""
    rank = ranks(s, size, depth)
    out = np.empty(len(s), np.int64)
    out[rank - 1] = np.arange(len(s))
    return out


def agree(data: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Which pairs of positions have the same depth bytes, compared 8 at a time."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    out, alive = np.zeros(len(a), bool), np.arange(len(a))
    at = depth - 8  # from the end: what only begins alike drops out first
    while True:
        k = max(at, 0)
        x, y = a[alive] + k, b[alive] + k
        same = np.ascontiguousarray(eight[x]).view(np.uint64).ravel() == np.ascontiguousarray(eight[y]).view(np.uint64).ravel()
        alive = alive[same]
        if at <= 0 or not len(alive):
            break
        at -= 8
    out[alive] = True
    return out
