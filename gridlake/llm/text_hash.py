"""Vectorised hashing of words, windows and shingles over Arrow string columns."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Text bytes hashed at a time, so that a task needs some tens of MB whatever the batch holds. One text is never cut.
SLICE_BYTES = 1 << 19
WORD_BASE, WINDOW_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@functools.lru_cache(4)
def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U))
    if lower:
        values[0x41:0x5B] = values[0x61:0x7B]
    return values


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        size = max(n, 1 << 16)
        table = np.full(size, base, U)
        table[0] = 1
        _POWERS[base] = np.cumprod(table, dtype=U)
    return _POWERS[base][:n]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets in them) of consecutive rows; null texts are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the index of each row's first word (one more than rows)."""
    word = ~separators[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, word
    after = np.empty(len(data) + 1, bool)
    after[-1], after[:-1] = False, word
    starts = np.flatnonzero(after & (~before | cut))
    ends = np.flatnonzero(before & (~after | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_byte_values(lower)[data] * powers(WORD_BASE, len(data)), out=sums[1:])
    inverse = powers(pow(WORD_BASE, -1, 1 << 64), len(data) + 1)
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of length words (over row ends too; callers leave those out)."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, U)
    sums = np.zeros(len(words) + 1, U)
    np.cumsum(words * powers(WINDOW_BASE, len(words)), out=sums[1:])
    inverse = powers(pow(WINDOW_BASE, -1, 1 << 64), n)
    return mix((sums[length:] - sums[:-length]) * inverse + U(length))


def sliding(op, values: np.ndarray, width: int) -> np.ndarray:
    """op (np.minimum or np.maximum) over each run of width values."""
    have = 1
    while have * 2 <= width:
        values = op(values[:-have], values[have:]) if len(values) > have else values[:0]
        have *= 2
    if width > have:
        rest = width - have
        values = op(values[:-rest], values[rest:]) if len(values) > rest else values[:0]
    return values
