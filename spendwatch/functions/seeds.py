"""Seeded draws in exact integer arithmetic, so that DuckDB repeats them bit for bit."""

from __future__ import annotations

import functools
import hashlib

import numpy as np

# Fixed values of the integer mixer (31-bit linear congruential steps).
MIX_A, MIX_C, MIX_M = 1103515245, 12345, 2147483648


def tree_seed_of(*parts) -> int:
    """A 28-bit integer seed from the md5 of the '|'-joined parts that are not None (first 7 hex digits)."""
    return int(hashlib.md5("|".join(str(p) for p in parts if p is not None).encode()).hexdigest()[:7], 16)


@functools.lru_cache(8)
def _numerals(n: int) -> list[bytes]:
    return [b"%d" % i for i in range(n)]


def tree_seeds(n: int, *parts) -> np.ndarray:
    """``tree_seed_of(*parts, i)`` for i in 0 .. n - 1."""
    start, md5 = "".join(f"{p}|" for p in parts if p is not None).encode(), hashlib.md5
    return (np.frombuffer(b"".join([md5(start + i).digest()[:4] for i in _numerals(n)]), ">u4") >> 4).astype(np.int64)


def mix_uniform_np(seed: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Uniform in [0, 1) from tree seeds and node ids; every product stays below 2^62."""
    a = (seed * 69069 + node * 362437 + 1) % MIX_M
    for _ in range(2):
        a = (a * MIX_A + MIX_C) % MIX_M
    return a / float(MIX_M)
