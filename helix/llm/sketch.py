"""DartMinHash: sketches of weighted sets by throwing darts.

An element's region is as wide as its weight. Darts are points thrown at all regions at a rate of one for each unit of weight and
of rank, by hashing (element, unit of weight, unit of rank), so equal regions are hit by the same darts. A set of weight w sees those
of rank under t / w, about t = k * (ln k + 2) of them whatever its size; each dart belongs to one of k coordinates, and a
coordinate's value is its earliest dart. Two sets agree in a coordinate with the probability of their weighted Jaccard similarity.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from helix.llm.words import U, mixed

NONE = U(0xFFFFFFFFFFFFFFFF)
NONE32 = np.uint32(0xFFFFFFFF)
#: Bits of a rank's fraction; the bits above are its unit.
FRACTION = 44
#: Bounds of the number of points of a Poisson process in a unit, as 64-bit values.
COUNTS = np.array([min(int(sum(math.exp(-1) / math.factorial(i) for i in range(n + 1)) * 2**64), 2**64 - 1) for n in range(16)], dtype=np.uint64)


def darts(cell: np.ndarray, part: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The darts that hit some units: which of the cells each hit, its hash, its rank. part: of the cell that the region covers (1: all)."""
    u = mixed(cell ^ mixed(unit.astype(U) + U(0x632BE59BD9B4E019)))
    count = np.searchsorted(COUNTS, u, "right")
    at = np.repeat(np.arange(len(u)), count)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    d = mixed(u[at] + (nth + 1).astype(U) * U(0xD1B54A32D192ED03))
    if (part < 1).any():
        inside = (mixed(d ^ U(0xA5A5A5A5A5A5A5A5)) >> U(11)) * 2.0**-53 < part[at]
        at, d = at[inside], d[inside]
    return at, d, (unit[at].astype(U) << U(FRACTION)) + (d >> U(64 - FRACTION))


def sketches(elements: np.ndarray, weights: np.ndarray, rows: np.ndarray, n: int, k: int) -> np.ndarray:
    """elements (64-bit) with positive weights, of n sets (rows: the set of each, in order) -> n x k values; those of an empty set are all NONE."""
    units = np.ceil(weights).astype(np.int64)
    at = np.repeat(np.arange(len(elements)), units)
    j = np.arange(len(at)) - np.repeat(np.cumsum(units) - units, units)
    cell, row = mixed(elements[at] + j.astype(U) * U(0x9FB21C651E98DF25)), rows[at]
    part = np.minimum(1.0, weights[at] - j)
    total = np.bincount(rows, weights, n)
    out = np.full((n, k), NONE)
    todo = total > 0
    limit = np.where(todo, k * (math.log(k) + 2) / np.where(todo, total, 1), 0)
    while todo.any():
        some = todo[row]
        c, p, r = cell[some], part[some], row[some]
        strips = np.maximum(1, np.ceil(limit)).astype(np.int64)[r]
        which = np.repeat(np.arange(len(c)), strips)
        unit = np.arange(len(which)) - np.repeat(np.cumsum(strips) - strips, strips)
        hit, d, rank = darts(c[which], p[which], unit)
        r = r[which[hit]]
        early = rank < (np.minimum(limit, 2.0**19) * 2.0**FRACTION).astype(U)[r]
        r, d, rank = r[early], d[early], rank[early]
        coordinate = (mixed(d) >> U(32)) * U(k) >> U(32)
        np.minimum.at(out.ravel(), r * k + coordinate.astype(np.int64), rank)
        todo &= (out == NONE).any(axis=1)  # of those, see later darts too
        limit = np.where(todo, limit * 2, limit)
    return out


def minhashes(values: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """Sketches of sets without weights: the least of the 32-bit products of each row's hashes and k odd factors: rows x k; all NONE32 for an empty row.

    offsets: of the rows in values. Runs of rows are small enough to stay in a core's cache.
    """
    h = (values >> U(32)).astype(np.uint32)
    n = len(offsets) - 1
    out = np.full((k, n), NONE32)
    full = np.flatnonzero(np.diff(offsets))
    starts = offsets[full]
    held = np.empty(0, np.uint32)
    first = 0
    while first < len(full):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + (1 << 16))))
        end = starts[last] if last < len(full) else offsets[-1]
        some, at = h[starts[first] : end], starts[first:last] - starts[first]
        held = held if len(held) >= len(some) else np.empty(len(some), np.uint32)
        product = held[: len(some)]
        for i in range(k):
            np.multiply(some, _odd(i), out=product)
            out[i, full[first:last]] = np.minimum.reduceat(product, at)
        first = last
    return out.T


@lru_cache(maxsize=None)
def _odd(i: int) -> np.uint32:
    """The i-th factor."""
    return np.uint32(int(mixed(np.array([i + 1], U) * U(0x9E3779B97F4A7C15))[0]) & 0xFFFFFFFF | 1)


def bytes_of(values: np.ndarray) -> np.ndarray:
    """One byte of each value: two sketches' share of equal bytes is about their similarity (and 1/256 of the rest)."""
    return (mixed(values.astype(U)) >> U(56)).astype(np.uint8)
