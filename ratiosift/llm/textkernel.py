"""Vectorised reading of Arrow text columns: words, word hashes and word n-gram hashes.

The functions work on the UTF-8 bytes of many texts at once and never build a Python string per word. All of them
treat a null text as an empty one. Work is cut into blocks of about ``BLOCK_BYTES``, and a text is never cut.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (finaliser of the public splitmix64 generator)."""
    with np.errstate(over="ignore"):
        x = x.astype(_U, copy=True)
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def unmix64(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mix64``."""
    with np.errstate(over="ignore"):
        x = x.astype(_U, copy=True)
        for shift, factor in ((31, 0x94D049BB133111EB), (27, 0xBF58476D1CE4E5B9), (30, None)):
            x ^= x >> _U(shift) ^ x >> _U(2 * shift)
            if factor:
                x *= _U(pow(factor, -1, 1 << 64))
    return x


_STEP = _U(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _BYTE_VALUE = mix64((np.arange(256, dtype=_U) + _U(1)) * _STEP)
_BASE = 0xD1342543DE82EF95


@functools.cache
def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``_BASE`` and of its inverse modulo 2**64, for exponents below ``BLOCK_BYTES``."""
    with np.errstate(over="ignore"):
        up = np.full(BLOCK_BYTES, _U(_BASE))
        up[0] = 1
        down = np.full(BLOCK_BYTES, _U(pow(_BASE, -1, 1 << 64)))
        down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _word_sums(values: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each word the sum of its bytes' values times powers of ``_BASE``, the first byte's power being 0. Works on some
    ``BLOCK_BYTES`` of words at a time, and on parts of a word that is longer."""
    up, down = _power_tables()
    out = np.zeros(len(start), _U)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            begin = int(start[i])
            j = int(np.searchsorted(end, begin + BLOCK_BYTES, side="right"))
            if j > i:
                terms = values[data[begin : end[j - 1]]]
                terms *= up[: len(terms)]
                own = start[i:j] - begin
                out[i:j] = np.add.reduceat(terms, own) * down[own]
                i = j
                continue
            for at in range(begin, int(end[i]), BLOCK_BYTES):
                terms = values[data[at : min(at + BLOCK_BYTES, int(end[i]))]]
                out[i] += (terms * up[: len(terms)]).sum(dtype=_U) * _U(pow(_BASE, at - begin, 1 << 64))
            i += 1
    return out


def byte_class(predicate) -> np.ndarray:
    """A table of 256 booleans: which byte values belong to a word."""
    return np.array([bool(predicate(b)) for b in range(256)])


#: Words are maximal runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
NOT_SPACE = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words are maximal runs of ASCII letters and digits and of all characters beyond ASCII.
ALNUM = byte_class(lambda b: b >= 0x80 or chr(b).isalnum())
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of consecutive texts of ``limit`` bytes together, or of one longer text."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """The words of a block of texts: ``start`` and ``end`` bytes, 64-bit ``hash``, and ``first``, the n + 1 places where
    each text's words begin."""

    __slots__ = ("data", "end", "first", "hash", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool = True) -> None:
        self.data = data
        n = len(data)
        inside = is_word[data]
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        edges = offsets[:-1]
        edges = edges[edges < n]
        before[edges] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        inner = edges[edges > 0]
        after[inner - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        values = np.where(is_word, _BYTE_VALUE[_LOWER] if lower else _BYTE_VALUE, _U(0))
        with np.errstate(over="ignore"):
            sums = _word_sums(values, data, self.start, self.end)
            sums += (self.end - self.start).astype(_U) * _STEP
        self.hash = mix64(sums)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        """For each word, the number of its text in the block."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def ngram_hashes(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` consecutive words, len(word_hash) - n + 1 of them, text borders ignored."""
    m = len(word_hash) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        acc = word_hash[:m].copy()
        for j in range(1, n):
            acc *= _U(0xA0761D6478BD642F)
            acc += word_hash[j : j + m]
        acc += _U(n) * _STEP
    return mix64(acc)


def ngram_starts(first: np.ndarray, n: int) -> np.ndarray:
    """The word positions at which ``n`` words of one text begin."""
    total = int(first[-1])
    ok = np.zeros(total + 1, dtype=np.int32)
    long = np.diff(first) >= n
    np.add.at(ok, first[:-1][long], 1)
    np.add.at(ok, first[1:][long] - n + 1, -1)
    return np.flatnonzero(np.cumsum(ok[:-1]) > 0)


def padded(data: np.ndarray, start: np.ndarray, end: np.ndarray, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some words one after another, each between ``left`` and ``right`` spaces, and the n + 1 places where
    they begin."""
    size = end - start
    first = np.concatenate(([0], np.cumsum(size + left + right)))
    flat = np.full(first[-1], 0x20, np.uint8)
    run = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    flat[np.repeat(first[:-1] + left, size) + run] = data[np.repeat(start, size) + run]
    return flat, first


def distinct(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of the words of a block, one place of each distinct word, and for every word the number of its distinct word."""
    _, where, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    return where, inverse


def text_sums(w: Words, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one per word) over each text."""
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[w.first[1:]] - total[w.first[:-1]]


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def release() -> None:
    """Gives freed memory back to the system; a worker keeps it otherwise, also while it waits for its next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over Arrow batches that releases its memory at its end."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        release()

    return run
