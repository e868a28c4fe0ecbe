"""Texts of a batch as arrays of code points, and properties of code points as lookup tables."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np


@cache
def category_table(first: str) -> np.ndarray:
    """For each code point, whether its Unicode category begins with one of the letters in ``first``."""
    category = unicodedata.category
    return np.fromiter((category(chr(c))[0] in first for c in range(0x110000)), dtype=bool, count=0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def kept(texts: list[str], first: str) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts whose category begins with a letter of ``first``, and how many each text has."""
    table = category_table(first)
    parts = [(a := code_points(t))[table[a]] for t in texts]
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32), sizes


def blocks(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Neighbouring items grouped to at most ``most`` in sum; a larger item stands alone."""
    out, start, total = [], 0, 0
    for k, n in enumerate(sizes):
        if k > start and total + n > most:
            out.append((start, k))
            start, total = k, 0
        total += n
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out


_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """The values scattered over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling_hashes(points: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` characters from each position; one per position that has so many behind it.

    A polynomial modulo 2**64: prefix sums of characters times powers of the base's inverse, taken back by
    powers of the base, so each window costs the same whatever its size.
    """
    n = len(points)
    if n < size:
        return np.zeros(0, np.uint64)
    inverse = np.uint64(pow(_BASE, -1, 1 << 64))
    steps = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, inverse))))
    sums = np.concatenate(([np.uint64(0)], np.cumsum((points.astype(np.uint64) + np.uint64(0x51ED)) * steps)))
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - size, np.uint64(_BASE)))))
    return mixed((sums[size:] - sums[:-size]) * powers)


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` neighbouring values."""
    if len(values) < size:
        return values[:0]
    have, out = 1, values
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def inside_one(sizes: np.ndarray, window: int, total: int) -> np.ndarray:
    """Of ``total - window + 1`` starts in concatenated texts, which windows lie inside one text."""
    count = max(0, total - window + 1)
    ends = np.repeat(np.cumsum(sizes), sizes)[:count]
    return np.arange(count) + window <= ends
