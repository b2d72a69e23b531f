"""Words and shingles of Arrow text columns as numpy arrays of 64-bit hashes.

A chunk is a run of whole texts laid end to end.  Words come from a byte class
table, a word's hash is a polynomial of random byte values read from prefix
sums, and shingle hashes combine the words' hashes, so no text is looped over
in Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1 << 20
_R = U(0x9E3779B97F4A7C13)
_RINV = U(pow(0x9E3779B97F4A7C13, -1, 1 << 64))

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
LOWER = _lower
SPACED = np.ones(256, bool)                      # words are runs without ASCII white space
SPACED[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, bool)                      # words are runs of 0-9, a-z and bytes above 0x7F
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for r in (_R, _RINV):
        p = np.full(n, r, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of the texts, bytes) of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return off, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, text bounds): whole texts, about ``limit`` bytes at a time."""
    off, data = text_buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def give_back() -> None:
    """Return a finished task's memory to the system: workers wait for the next task, beside the JVM."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


class Words:
    """Words of a chunk: ``hash``, ``doc`` (text number), byte ``start`` and ``end``; ``first`` word of each text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray, lower: bool = True):
        self.n_docs = len(bounds) - 1
        self.low = LOWER[data] if lower else data
        n = len(data)
        inside = is_word[self.low]
        filled = bounds[1:] > bounds[:-1]
        before = np.empty(n, bool)
        before[1:] = inside[:-1]
        before[bounds[:-1][filled]] = False
        after = np.empty(n, bool)
        after[:-1] = inside[1:]
        after[bounds[1:][filled] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(bounds[1:], self.start, side="right")
        self.hash = self._hashes()
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    def _hashes(self) -> np.ndarray:
        start, end, n = self.start, self.end, len(self.start)
        out = np.empty(n, np.uint64)
        i = 0
        while i < n:                              # once for a usual chunk; long texts go in runs of words
            j = max(i + 1, int(np.searchsorted(end, start[i] + CHUNK_BYTES, side="right")))
            lo, size = start[i], int(end[j - 1] - start[i])
            up, down = _powers(1 << max(20, int(size).bit_length()))
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(_VALUE[self.low[lo:lo + size]] * up[:size], out=sums[1:])
            s, e = start[i:j] - lo, end[i:j] - lo
            out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * U(0x2545F4914F6CDD1D))
            i = j
        return out

    def window(self, at: np.ndarray, k: int) -> np.ndarray:
        """Hash of the ``k`` words from each position."""
        out = np.full(len(at), k, np.uint64)
        for j in range(k):
            out = out * _R + self.hash[at + j]
        return mix(out)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted within each text; bounds of the texts in them).

    A text with fewer than ``k`` words, but not none, has its whole word sequence as its one shingle.
    """
    n = len(words.hash)
    at = np.arange(max(n - k + 1, 0))
    at = at[words.doc[at] == words.doc[at + k - 1]] if len(at) else at
    h, doc = words.window(at, k), words.doc[at]
    count = words.counts()
    for m in range(1, k):
        short = np.flatnonzero(count == m)
        if len(short):
            h = np.concatenate([h, words.window(words.first[short], m)])
            doc = np.concatenate([doc, short])
    order = np.argsort(doc, kind="stable")
    h, doc = h[order], doc[order]
    bounds = np.searchsorted(doc, np.arange(words.n_docs + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.searchsorted(doc[keep], np.arange(words.n_docs + 1))
