"""Hashes of words and of five-word shingles for whole batches, by numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and n + 1 offsets. A word is a run of bytes other than space and 9 to 13."""
    texts = texts.cast(pa.large_string()).cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    # a word also ends where its text ends
    starts = inside[1:] & ~inside[:-1]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    starts[first] |= inside[1:][first]
    begin = np.flatnonzero(starts[:-1])
    stop = inside[1:-1] & ~inside[2:]
    last = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    stop[last] |= inside[1:-1][last]
    end = np.flatnonzero(stop) + 1
    powers = _powers(_BASE, len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)])
    hashes = (sums[end] - sums[begin]) * _powers(_INVERSE, len(data))[begin]
    return mix(hashes + (end - begin).astype(np.uint64) * _BASE), np.searchsorted(begin, bounds)


def shingles(texts: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled hashes of all runs of k words, in text order, and n + 1 offsets. A text of fewer words has one shingle of
    them all, a text without words none."""
    w, at = words(texts)
    sizes = np.diff(at)
    counts = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    index = np.repeat(at[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
    owner = np.repeat(np.arange(len(sizes)), counts)
    room = at[1:][owner] - index
    out = np.zeros(len(index), np.uint64)
    for i in range(k):
        here = room > i
        out[here] = mix(out[here] * _BASE + w[index[here] + i])
    # the n-th occurrence of a shingle in its text is another one
    own = mix(out ^ mix(owner.astype(np.uint64)))
    order = np.argsort(own, kind="stable")
    same = np.concatenate([[False], (own[order][1:] == own[order][:-1])])
    if same.any():
        runs = np.arange(len(own)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(own))))
        nth = np.empty(len(own), np.uint64)
        nth[order] = runs
        out = np.where(nth > 0, mix(out + nth * _BASE), out)
    return out, bounds
