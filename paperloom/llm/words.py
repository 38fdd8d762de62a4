"""Vectorised words, hashes and shingles of UTF-8 text held in Arrow buffers.

A word is a run of bytes outside space and TAB..CR. The functions here work on whole Arrow batches in
slices of bounded size, so their memory does not follow the number or the length of the texts.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000
#: Longer words are hashed by blake2b, byte by byte in constant memory.
LONG_WORD = 65_536

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
    _POWER = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(LONG_WORD, 0xD6E8FEB86659FD93, np.uint64)]))


def frugal(run: Callable) -> Callable:
    """``run`` over batches, then what it freed goes back to the system, for worker processes outlive their tasks."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)

    return task


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row + 1, bytes, offsets)`` of consecutive rows with about ``most`` bytes; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of each text (one entry more than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = True, space[:-1]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1], after[:-1] = True, space[1:]
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the words; with ``lower``, A-Z count as a-z."""
    out = np.zeros(len(starts), dtype=np.uint64)
    if not len(starts):
        return out
    length = ends - starts
    long = np.flatnonzero(length > LONG_WORD)
    size = np.where(length > LONG_WORD, 0, length)
    total = np.concatenate([[0], np.cumsum(size)])
    first = 0
    with np.errstate(over="ignore"):
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(total, total[first] + SLICE_BYTES, side="right")) - 1)
            sizes, begin = size[first:last], total[first:last] - total[first]
            if count := int(sizes.sum()):
                place = np.arange(count) - np.repeat(begin, sizes)
                letters = data[np.repeat(starts[first:last], sizes) + place]
                values = _BYTE[_LOWER[letters] if lower else letters] * _POWER[place]
                some = sizes > 0
                out[first:last][some] = np.add.reduceat(values, begin[some])
            first = last
        out = mix(out + length.astype(np.uint64) * _STEP)
    for i in long:
        letters = data[starts[i] : ends[i]]
        digest = hashlib.blake2b((_LOWER[letters] if lower else letters).tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def windows(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``width`` consecutive entries; entry i is the window that starts at i."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    factor = np.uint64((0xA0761D6478BD642F + 2 * seed * 0xE7037ED1A0B428DB) & 0xFFFFFFFFFFFFFFFF | 1)
    with np.errstate(over="ignore"):
        out = np.full(n, seed + width, dtype=np.uint64)
        for i in range(width):
            out = out * factor + hashes[i : i + n]
            if i % 4 == 3:
                out = mix(out)
        return mix(out)


def shingle_sets(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of every text, end to end, and where each text's set begins.

    A text with fewer words than ``width`` has its whole sequence as its one shingle; one without words none.
    """
    n_words = np.diff(first)
    docs = len(n_words)
    all_windows = windows(hashes, width)
    owner = np.repeat(np.arange(docs), n_words)
    inside = np.arange(len(hashes)) - first[owner] + width <= n_words[owner]
    at = np.flatnonzero(inside)
    tokens, owners = all_windows[at], owner[at]
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):
        few = np.array([windows(hashes[first[d] : first[d + 1]], int(n_words[d]))[0] for d in short], dtype=np.uint64)
        tokens, owners = np.concatenate([tokens, few]), np.concatenate([owners, short])
    order = np.lexsort((tokens, owners))
    tokens, owners = tokens[order], owners[order]
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])
    tokens, owners = tokens[new], owners[new]
    return tokens, np.searchsorted(owners, np.arange(docs + 1))
