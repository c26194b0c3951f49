"""Vectorised text primitives on Arrow string buffers.

Everything here works on the UTF-8 bytes of a whole Arrow batch at once, so no
Python object is made per word.  A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are expanded to arrays at a time (one longer text is still taken whole).
CHUNK_BYTES = 256 << 10

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_MULT = _U(0x9E3779B97F4A7C15)
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_OF_LOWER = _BYTE[_LOWER]
_INVERSE = pow(int(_MULT), -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, out=out)


_AHEAD, _BACK = _powers(int(_MULT), CHUNK_BYTES), _powers(_INVERSE, CHUNK_BYTES)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def trim() -> None:
    """Gives memory that a task has freed back to the system: workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def trimmed(run):
    """A function over batches that trims when it is through."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most ``most`` bytes of text, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offs = utf8(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased), and the n + 1 offsets of each row's words."""
    if data.size == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    inside = (data != 0x20) & (data - np.uint8(9) > 4)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offs[:-1][offs[:-1] < offs[1:]]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    if starts.size == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    ends = np.ones(len(data), bool)  # of a word's last byte: before a space, or before the next row's word
    np.logical_not(inside[1:], out=ends[:-1])
    ends[:-1] |= begins[1:]
    ends &= inside
    ends = np.flatnonzero(ends)
    # a word's sum of its bytes by the powers of its places: a difference of running sums, moved to the word's start
    ahead, back = (_AHEAD, _BACK) if len(data) <= CHUNK_BYTES else (_powers(int(_MULT), len(data)), _powers(_INVERSE, len(data)))
    h = np.empty(len(data), np.uint64)
    np.take(_BYTE_OF_LOWER, data, out=h, mode="clip")
    h *= ahead[: len(data)]
    np.cumsum(h, out=h)
    before = h[starts] - np.take(_BYTE_OF_LOWER, data[starts]) * ahead[starts]
    h = (h[ends] - before) * back[starts]
    return mix(h + (ends - starts + 1).astype(np.uint64)), np.searchsorted(starts, offs)


def shingles(word: np.ndarray, woffs: np.ndarray, k: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles in order, with repeats, and their offsets.

    A row of fewer words (but any) has its whole sequence as its one shingle; a
    row without words has none.
    """
    count = np.diff(woffs)
    many = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    offs = np.concatenate([[0], np.cumsum(many)])
    total = int(offs[-1])
    if total == 0:
        return np.zeros(0, np.uint64), offs
    at = np.arange(total, dtype=np.int64) - np.repeat(offs[:-1] - woffs[:-1], many)
    padded = np.concatenate([word, np.zeros(k, np.uint64)])
    h = padded[at] * _STEP[0]
    for j in range(1, k):
        h += padded[at + j] * _STEP[j]
    for row in np.flatnonzero((count > 0) & (count < k)):
        own = word[woffs[row] : woffs[row + 1]]
        h[offs[row]] = np.add.reduce(np.append(own * _STEP[: len(own)], _STEP[k : k + 1] * _U(len(own))))
    return mix(h) >> _U(64 - bits), offs


def distinct(h: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct hashes (below 2**bits) in rising order: hashes, row of each, offsets."""
    rows = len(offs) - 1
    row = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(offs))
    if rows <= 1 << (64 - bits):
        both = np.sort((row << _U(bits)) | h)
        both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
        row, h = (both >> _U(bits)).astype(np.int64), both & _U((1 << bits) - 1)
    else:
        order = np.lexsort((h, row))
        row, h = row[order].astype(np.int64), h[order]
        first = np.ones(len(h), bool)
        first[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        row, h = row[first], h[first]
    return h, row, np.searchsorted(row, np.arange(rows + 1))
