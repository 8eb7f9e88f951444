"""Whole Arrow batches of texts as byte arrays: words, lines and their fingerprints in numpy.

Texts are handled in chunks of about ``CHUNK`` bytes, so memory doesn't follow
the size of a batch; a single longer text makes a chunk of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
U = np.uint64

#: The bytes that part words: space, and tab to carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.default_rng(20240501)
_TABLES = _rng.integers(0, 2**64, (2, 256), dtype=U)
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 2**64)
_powers = [np.ones(1, U), np.ones(1, U)]


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Texts:
    """Some texts on end: ``buf`` holds their bytes, text i is ``buf[at[i]:at[i + 1]]``."""

    def __init__(self, buf: np.ndarray, at: np.ndarray, first: int):
        self.buf, self.at, self.first, self.n = buf, at, first, len(at) - 1
        self._sums: dict[int, np.ndarray] = {}

    def prints(self, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
        """64-bit fingerprints of the spans [start, end), equal for equal bytes; lanes 0 and 1 are independent."""
        power, inverse = _grown(len(self.buf) + 1)
        if lane not in self._sums:
            sums = np.zeros(len(self.buf) + 1, U)
            np.cumsum(_TABLES[lane][self.buf] * power[: len(self.buf)], out=sums[1:])
            self._sums[lane] = sums
        raw = (self._sums[lane][end] - self._sums[lane][start]) * inverse[start]
        return mix(raw + (end - start).astype(U) * U(0xD6E8FEB86659FD93))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and for each text the number of words before it."""
        full = ~BLANK[self.buf]
        first, last = full.copy(), full.copy()
        first[1:] &= ~full[:-1]
        last[:-1] &= ~full[1:]
        edge = self.at[1:-1]
        edge = edge[(edge > 0) & (edge < len(full))]
        first[edge] = full[edge]
        last[edge - 1] = full[edge - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return start, end, np.searchsorted(start, self.at)

    def count(self, flags: np.ndarray) -> np.ndarray:
        """For each text the number of set flags among its bytes."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.at[1:]] - sums[self.at[:-1]]


def owner(at: np.ndarray) -> np.ndarray:
    """For each item the text that has it, given how many items come before each text."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def strings(column: pa.Array) -> pa.LargeStringArray:
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Texts]:
    """The texts of an Arrow column in order, null as empty."""
    column = strings(column)
    if not len(column):
        return
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield Texts(buf[at[i] : at[j]], at[i : j + 1] - at[i], i)
        i = j


#: What empties the caches that some functions leave in a worker for its next task.
CACHES: list[Callable[[], None]] = [lambda: _powers.__setitem__(slice(None), [np.ones(1, U), np.ones(1, U)])]


def give_back() -> None:
    """Returns to the system what Arrow and the C library hold free."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim:
        trim(0)


def _emptied() -> None:
    for empty in CACHES:
        empty()
    give_back()


def tidy(run: Callable) -> Callable:
    """``run`` for a worker that lives on through other stages: nothing but its modules is kept from task to task.

    ``run`` takes an iterator of batches and yields batches, or takes a group's table and returns one.
    """

    def tidied(given):
        if isinstance(given, pa.Table):
            try:
                return run(given)
            finally:
                _emptied()
        return _mapped(run, given)

    return tidied


def _mapped(run: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _emptied()
    try:
        yield from run(batches)
    finally:
        _emptied()


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPREAD = np.random.default_rng(3).integers(0, 2**64, 64, dtype=U) | U(1)


def lowered(t: Texts) -> Texts:
    """The texts with A-Z in lower case."""
    return Texts(LOWER[t.buf], t.at, t.first)


def shingle_sets(t: Texts, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct fingerprints of its runs of ``width`` words.

    A text with fewer words has its whole sequence as one; without words, none.
    """
    start, end, at = t.words()
    word = t.prints(start, end)
    n = len(word) - width + 1
    runs = np.zeros(max(0, n), U)
    for j in range(width if n > 0 else 0):
        runs += word[j : j + n] * _SPREAD[j]
    runs = mix(runs)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            whole = np.array([b - a], U)
            for j in range(b - a):
                whole += word[a + j : a + j + 1] * _SPREAD[j + 32]
            out.append(mix(whole))
        else:
            out.append(np.zeros(0, U))
    return out
