"""Words of many texts at once, as 64-bit hashes, straight from Arrow's buffers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; arrays of eight bytes a character stay in a few tens of MB.
CHUNK = 1 << 19
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 3)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = []

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The separators of whole words, and those that leave letters and digits alone.
BLANKS = np.zeros(256, bool)
BLANKS[[32, 9, 10, 11, 12, 13]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False


def tidy(run: Callable) -> Callable:
    """``run`` over a task's batches, after which the worker, which waits for other tasks, gives its free memory back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            libc = ctypes.CDLL(None)
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(CHUNK, 1 << int(n).bit_length())
        one = np.ones(1, np.uint64)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([one, np.full(size - 1, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _POWERS


def _hash_range(data: np.ndarray, lo: int, hi: int, firsts: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = data[lo:hi]
    inside = ~blank[raw]
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = firsts - lo
    cut = cut[(cut > 0) & (cut < len(raw))]
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _powers(len(raw))
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[_LOWER[raw]] * power[: len(raw)], out=total[1:])
    return s + lo, e + lo, mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word, and for each text the index of its first word (one more at the end).

    Words are runs of bytes outside ``blank``, A-Z lower-cased; none crosses
    from one text to the next. Long texts are cut at blanks, so memory depends
    on the longest word only.
    """
    at, stop, out = int(offsets[0]), int(offsets[-1]), []
    while at < stop:
        cut = min(stop, at + CHUNK)
        while cut < stop:
            near = np.flatnonzero(blank[data[cut : cut + CHUNK]])
            text = offsets[np.searchsorted(offsets, cut)]
            cut = min(cut + int(near[0]), int(text)) if len(near) else min(cut + CHUNK, int(text))
            if len(near) or cut == text or cut == stop:
                break
        out.append(_hash_range(data, at, cut, offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, cut, "right")], blank))
        at = cut
    if not out:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    s, e, h = (np.concatenate(x) for x in zip(*out, strict=True))
    return s, e, h, np.searchsorted(s, offsets)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes, by position; a run that leaves the array has none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _BASE + h[j : j + n]
    return mix(out + np.uint64(k))


def slices(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes, as index ranges; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def shingle_sets(column: pa.Array, k: int = 5, counted=None) -> Iterator[tuple[int, np.ndarray]]:
    """For each text its index and its sorted distinct k-word hashes; fewer words are one sequence, none an empty set.

    ``counted`` is called with the word hashes of each chunk of texts.
    """
    data, offsets = buffers(column)
    for i, j in slices(offsets):
        _, _, h, first = words(data, offsets[i : j + 1])
        if counted is not None:
            counted(h)
        grams = windows(h, k)
        for t in range(i, j):
            a, b = first[t - i], first[t - i + 1]
            if b - a >= k:
                x = np.sort(grams[a : b - k + 1])
                yield t, x[np.concatenate([[True], x[1:] != x[:-1]])]
            else:
                yield t, windows(h[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64)


def ranked_sets(column: pa.Array, k: int, cost: np.ndarray, bucket) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As ``shingle_sets``, with the summed ``cost`` of each shingle's words, costs being looked up by ``bucket`` of a word hash."""
    data, offsets = buffers(column)
    for i, j in slices(offsets):
        _, _, h, first = words(data, offsets[i : j + 1])
        grams = windows(h, k)
        total = np.concatenate([[0], np.cumsum(cost[bucket(h)])])
        for t in range(i, j):
            a, b = first[t - i], first[t - i + 1]
            if b - a >= k:
                x, at = np.unique(grams[a : b - k + 1], return_index=True)
                yield t, x, total[at + a + k] - total[at + a]
            else:
                yield t, windows(h[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64), np.zeros(int(b > a), np.int64)
