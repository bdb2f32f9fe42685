"""Hashing of words and byte ranges of whole Arrow string columns, without a Python loop over rows.

A prefix sum of byte codes times powers of an odd number (modulo 2**64) gives the hash of any byte
range from two lookups, so tokens and windows of a batch are hashed by a few numpy passes.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
#: Bytes of text hashed at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19

# Workers give freed batches and arrays back to the system; Arrow's own pool would keep them, and so would malloc,
# which raises the size from which it maps arrays of their own (M_MMAP_THRESHOLD, -3) with what was freed before.
pa.set_memory_pool(pa.system_memory_pool())
if hasattr(ctypes.CDLL(None), "mallopt"):
    ctypes.CDLL(None).mallopt(-3, 1 << 18)



def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` on a task's batches. At its end all that was freed goes back to the system, with the tables of powers: the worker stays, idle, while later stages run."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        _tables.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


_tables: dict[str, np.ndarray] = {}


def _codes(seed: int = 0) -> np.ndarray:
    key = f"codes{seed}"
    if key not in _tables:
        _tables[key] = np.random.default_rng(91 + seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _tables[key]


def _powers(name: str, base: int, n: int) -> np.ndarray:
    if name not in _tables or len(_tables[name]) < n:
        size = max(n, CHUNK_BYTES + 2)
        out = np.full(size, np.uint64(base))
        out[0] = 1
        _tables[name] = np.cumprod(out)
    return _tables[name]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of a 64-bit number."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """Prefix sums P such that ``range_hash(P, s, e)`` depends only on the bytes of [s, e)."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_codes(seed)[data] * _powers("up", MULTIPLIER, len(data) + 1)[: len(data)], out=out[1:])
    return out


def range_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    down = _powers("down", INVERSE, len(p) + 1)
    return mix((p[end] - p[start]) * down[start] + (end - start).astype(np.uint64))


def gram_hash(p: np.ndarray, k: int) -> np.ndarray:
    """``range_hash`` of each k consecutive bytes."""
    n = len(p) - k
    h = p[k:] - p[:n]
    h *= _powers("down", INVERSE, len(p) + 1)[:n]
    h += np.uint64(k)
    return mix(h)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of consecutive rows, split at row ends."""
    data, at = utf8(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


#: Byte values that separate words: the ASCII white space of `[\x20\x09-\x0D]`.
BLANKS = np.zeros(256, bool)
BLANKS[[32, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, at: np.ndarray, separators: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each run of bytes that aren't separators; runs end where rows end."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~separators[data]
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begin[edges] = inside[edges]
    finish[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def windows(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k consecutive words of one row, and the position of its first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(row[:n] == row[k - 1 :])
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + hashes[i : n + i]
    return mix(h[first] ^ np.uint64(k)), first
