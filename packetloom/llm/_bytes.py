"""Vectorised passes over the UTF-8 bytes of a column of texts.

An Arrow string column already holds its texts end to end in one buffer; the functions here work on
slices of that buffer with numpy and never make a Python string for a word. Memory is bounded by
PIECE: texts are taken in runs of about so many bytes, and one longer text in several pieces.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

_ascii = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, all else as it is.
LOWER = np.where((_ascii >= 65) & (_ascii <= 90), _ascii + 32, _ascii).astype(np.uint8)
#: Bytes of words: ASCII letters and digits, and all of other scripts.
IS_WORD = ((_ascii >= 48) & (_ascii <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (_ascii >= 128)
#: Letters in lower case, all else a space.
LETTERS = np.where(((LOWER >= 97) & (LOWER <= 122)) | (_ascii >= 128), LOWER, 32).astype(np.uint8)


def release() -> None:
    """Give freed memory back to the system: a Python worker stays after its task, and what it holds with it."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def column_bytes(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and len + 1 offsets; a null is empty. lower: of all scripts' letters."""
    if lower and len(column):
        column = pc.utf8_lower(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes together; a longer text stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def pieces(data: np.ndarray, overlap_words: int = 0, limit: int = PIECE) -> Iterator[np.ndarray]:
    """A text in pieces that end where a word ends; each begins overlap_words words early.

    A run of word bytes longer than half of limit is cut where limit falls. A piece with fewer words
    than twice overlap_words grows until it has them, so that the next can begin early enough.
    """
    start, size, n = 0, limit, len(data)
    while n - start > size:
        cut = start + size
        gaps = np.flatnonzero(~IS_WORD[data[start + size // 2 : cut]])
        if len(gaps):
            cut = start + size // 2 + int(gaps[-1]) + 1
        begin = cut
        if overlap_words:
            word = IS_WORD[data[start:cut]]
            begins = np.flatnonzero(word[1:] & ~word[:-1]) + 1
            if len(begins) < 2 * overlap_words:
                size *= 2
                continue
            begin = start + int(begins[-overlap_words])
        yield data[start:cut]
        start, size = begin, limit
    yield data[start:]


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD ** i and its inverse modulo 2 ** 64, for i below n."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        up, down = np.full(size, _ODD, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser: each bit of the result depends on all bits of h."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """len + 1 running polynomial sums, for range_hash."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], the same for the same bytes anywhere."""
    return mixed((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the index of its first word (and one more)."""
    word = is_word[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] = word[edge]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = word[last]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]], zero for an empty range."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:], dtype=np.float64)
    return total[bounds[1:]] - total[bounds[:-1]]


def segment_max(values: np.ndarray, bounds: np.ndarray, empty: float) -> np.ndarray:
    """Maxima of values[bounds[i]:bounds[i + 1]], empty for an empty range."""
    out = np.full((len(bounds) - 1, *values.shape[1:]), empty, values.dtype)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.maximum.reduceat(values, bounds[:-1][full], axis=0)
    return out
