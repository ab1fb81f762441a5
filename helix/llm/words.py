"""Words of a batch of texts as arrays: where they start and end, and a 64-bit hash of each."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SEED = np.random.default_rng(20240229)
#: A random odd factor for the powers of a polynomial, and a random value for each byte.
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
VALUES = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64)
FACTORS = _SEED.integers(1, 1 << 63, 64, dtype=np.uint64) | U(1)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: after A-Z are lower-cased, digits, a-z and all of multi-byte characters.
ALNUM = np.array([48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128 for b in range(256)])
#: Bytes of tokens: all but space, tab, line feed, vertical tab, form feed, carriage return.
NONSPACE = np.array([b not in b" \t\n\v\f\r" for b in range(256)])


#: What a worker keeps from task to task. A task of another kind, which has no use for it, drops it.
KEPT: dict[str, object] = {}


def releasing(run: Callable, keeps: bool = False) -> Callable:
    """run, a function of Arrow batches; when it ends, what it has freed goes back to the system, as a worker lives on and other stages need the memory. keeps: it
    uses what is in KEPT."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            KEPT.clear()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # where the C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return released


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = max(n, 1 << 18)
        for k, b in (("up", BASE), ("down", INVERSE)):
            _POWERS[k] = np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, b)]), dtype=U)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def chunks(column: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A text column in runs of rows of about limit bytes (a longer text alone): the run's first row, its bytes, the offsets of its rows in
    them. Null is as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of member bytes within each row: starts, ends, and the offsets of the rows in them."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = member[data]
    before, here, after = inside[:-2].copy(), inside[1:-1], inside[2:].copy()
    cuts = offsets[1:-1]
    before[cuts[cuts < len(data)]] = False
    after[cuts[cuts > 0] - 1] = False
    starts, ends = np.flatnonzero(here & ~before), np.flatnonzero(here & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of each span's bytes, folded."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(VALUES[fold][data] * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts])


def combined(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive hashes; there are len(h) - n + 1."""
    if len(h) < n:
        return np.zeros(0, U)
    total = h[: len(h) - n + 1] * FACTORS[0]
    for i in range(1, n):
        total = total + h[i : len(h) - n + 1 + i] * FACTORS[i]
    return mixed(total + U(n))


def runs(word_offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of n words start that stay within a row, and their rows."""
    last = word_offsets[-1] - n + 1
    if last <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(word_offsets) - 1), np.diff(word_offsets))
    at = np.flatnonzero(row[:last] == row[n - 1 :])
    return at, row[at]
