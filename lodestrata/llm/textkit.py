"""Word segmentation and hashing of a whole Arrow batch with numpy: no Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240917))
#: One random 64-bit value for each byte; upper-case ASCII letters share those of lower case.
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_IS_SPACE] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)
#: Bytes of text that are segmented at once; keeps temporaries near 50 MB at most.
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 4096), _STEP, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def byte_values() -> np.ndarray:
    """The value of each byte in hashes of words."""
    return _BYTE


def position_powers(n: int) -> np.ndarray:
    """Factors of the first n bytes of a word, or more."""
    return _power(n)


@dataclass
class Words:
    """Words of several texts. word i is bytes[start[i]:end[i]]; text d has words first[d]:first[d+1]."""

    bytes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    rows: slice

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def words(column: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[Words]:
    """Segments a string column (no nulls) in slices of whole texts of about slice_bytes."""
    if not len(column):
        return
    data, offsets = _buffers(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + slice_bytes, "right")) - 1)
        yield _segment(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], slice(low, high))
        low = high


def _segment(data: np.ndarray, offsets: np.ndarray, rows: slice) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), rows)
    black = ~_IS_SPACE[data]
    opens = np.ones(n, bool)  # what stands before a byte isn't part of its word
    opens[1:] = ~black[:-1]
    opens[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(black & opens)
    closes = np.ones(n, bool)
    closes[:-1] = opens[1:] | ~black[1:]
    end = np.flatnonzero(black & closes) + 1
    if len(start):
        head = int(start[0])
        span = np.diff(np.append(start, n))
        place = np.arange(n - head) - np.repeat(start - head, span)
        longest = int(span.max())
        value = _BYTE[data[head:]] * _power(longest)[place]
        hashed = mix(np.add.reduceat(value, start - head) + (end - start).astype(np.uint64) * _STEP)
    else:
        hashed = np.zeros(0, np.uint64)
    return Words(data, start, end, hashed, np.searchsorted(start, offsets), rows)


_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def runs(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and first[]: text d has runs first[d]:first[d+1]."""
    counts = np.maximum(np.diff(w.first) - size + 1, 0)
    first = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(first[-1]) + np.repeat(w.first[:-1] - first[:-1], counts)
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = out * _FACTOR + w.hash[at + k]
    return mix(out), first


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its word shingles); a shorter text is one shingle, one without words has none."""
    for w in words(column):
        hashed, first = runs(w, size)
        n_words = np.diff(w.first)
        for d in range(len(n_words)):
            if n_words[d] >= size:
                one = np.unique(hashed[first[d] : first[d + 1]])
            elif n_words[d]:
                total = np.uint64(n_words[d])
                with np.errstate(over="ignore"):
                    for x in w.hash[w.first[d] : w.first[d + 1]]:
                        total = total * _FACTOR + x
                one = mix(np.array([total]))
            else:
                one = np.zeros(0, np.uint64)
            yield w.rows.start + d, one
