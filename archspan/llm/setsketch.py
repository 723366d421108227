"""SetSketch registers of sets, and the joint estimate of two sets' similarity.

A register holds floor(1 - log_b x) for the least x of exponentially distributed
values of the set's elements, cut off at 0 and at the largest value: registers of a
union are the maxima of the registers, and equal registers become likelier with
similarity.
"""

from __future__ import annotations

import numpy as np

REGISTERS = 128
BASE = 1.02
LARGEST = 2046  # x from BASE**-2045 on
PART = 16_000  # shingles whose values are held at once


def _multipliers(m: int) -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 63, m, np.uint64) * np.uint64(2) + np.uint64(1)


def sketches(hashes: np.ndarray, counts: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Registers (uint16) of each set; an empty set has zeros. hashes: of the sets, one behind the other."""
    least = np.full((len(counts), m), np.iinfo(np.uint32).max, np.uint32)
    mult, ends = _multipliers(m), np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    for at in range(0, len(hashes), PART):
        part = hashes[at : at + PART]
        who = owner[at : at + PART]
        cut = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        value = ((part[:, None] * mult) >> np.uint64(32)).astype(np.uint32)
        low = np.minimum.reduceat(value, cut, axis=0)
        least[who[cut]] = np.minimum(least[who[cut]], low)
    u = (least.astype(float) + 0.5) / 2.0**32
    x = -np.log1p(-u)
    out = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LARGEST).astype(np.uint16)
    out[(ends - counts) == ends] = 0
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Likeliest Jaccard similarity of each pair of rows, given sizes: golden section on the joint likelihood of greater, less and equal registers."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = n_a / np.maximum(1, n_a + n_b)
    v = 1 - u
    scale = (BASE - 1) / BASE

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * scale) / np.log(BASE)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, 0) + tiny)

    low, high = np.zeros(len(a)), np.minimum(u / np.maximum(v, 1e-12), v / np.maximum(u, 1e-12)).clip(0, 1)
    gold = (np.sqrt(5) - 1) / 2
    for _ in range(30):
        x, y = high - gold * (high - low), low + gold * (high - low)
        left = likelihood(x) > likelihood(y)
        high, low = np.where(left, y, high), np.where(left, low, x)
    return (low + high) / 2
