"""Word and shingle hashes of whole texts, computed on the bytes of an Arrow column at once."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together; a longer text is a piece by itself.
PIECE = 1 << 20
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: All bytes but space and tab to carriage return.
UNSPACED = np.ones(256, bool)
UNSPACED[[32, 9, 10, 11, 12, 13]] = False
#: Letters a to z (after folding), digits, and all bytes of characters beyond ASCII.
WORDLIKE = np.zeros(256, bool)
WORDLIKE[48:58] = WORDLIKE[65:91] = WORDLIKE[97:123] = WORDLIKE[128:] = True
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)[FOLD]
_BASE = 0x9E3779B97F4A7C15 | 1


def frugal(run: Callable) -> Callable:
    """run (batches to batches) that hands freed memory back to the system when its task ends, as workers are reused."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers_of(base: int) -> np.ndarray:
    steps = np.full(PIECE + 1, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


#: Powers of the base and of its inverse modulo 2^64, for the places of one piece.
_UP, _DOWN = _powers_of(_BASE), _powers_of(pow(_BASE, -1, 1 << 64))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def pieces(at: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about size bytes of text."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, at: np.ndarray, wordlike: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts data[at[i]:at[i + 1]]: hash, start and end of every word, and each text's range of words.

    A word's hash is a polynomial of its bytes, read off running sums at its start and end. They are summed
    piece by piece, so that a very long text needs room for its words but not for sums at all its bytes.
    """
    low, high = int(at[0]), int(at[-1])
    none = np.zeros(0, np.int64)
    starts, ends, sums, downs, tops = [none], [none], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    total, was = np.uint64(0), False
    for first in range(low, high, PIECE):
        d = data[first : min(first + PIECE, high)]
        n = len(d)
        # Bounds of texts cut words; a piece's own bounds don't.
        cuts = at[np.searchsorted(at, first, "left") : np.searchsorted(at, first + n, "left")] - first
        inside = np.empty(n + 1, bool)
        inside[0] = was
        inside[1:] = wordlike[d]
        cut = np.zeros(n, bool)
        cut[cuts] = True
        start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        up, down = np.uint64(pow(_BASE, first - low, 1 << 64)), np.uint64(pow(_BASE, low - first, 1 << 64))
        total_at = np.empty(n + 1, np.uint64)
        total_at[0] = 0
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[d] * _UP[:n], out=total_at[1:])
            sums.append(total + up * total_at[start])
            tops.append(total + up * total_at[end])
            downs.append(down * _DOWN[start])
            total = total + up * total_at[n]
        starts.append(start + first)
        ends.append(end + first)
        was = bool(inside[n])
    if was:
        ends.append(np.array([high]))
        tops.append(np.array([total], np.uint64))
    start, end = np.concatenate(starts), np.concatenate(ends)
    with np.errstate(over="ignore"):
        h = mix((np.concatenate(tops) - np.concatenate(sums)) * np.concatenate(downs))
    return h, start, end, np.searchsorted(start, at)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out + h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out)
