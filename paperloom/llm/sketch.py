"""A filter of fixed size for 64-bit hashes, built by the executors slice by slice.

The filter only saves shuffled rows: what passes it is always decided by an exact join. Its size is a
parameter, so the broadcast is bounded whatever the input; a full filter lets everything pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: 2 ** 22 words of 64 bits: 32 MB on the driver and in each Python worker.
WORDS = 1 << 22
SLICES = 64


def _masks(hashes: np.ndarray) -> np.ndarray:
    one = np.uint64(1)
    mask = one << (hashes & np.uint64(63))
    for shift in (6, 12, 18):
        mask |= one << ((hashes >> np.uint64(shift)) & np.uint64(63))
    return mask


def _places(hashes: np.ndarray, words: int) -> np.ndarray:
    return ((hashes >> np.uint64(24)) % np.uint64(words)).astype(np.int64)


def sliced(hashes: np.ndarray, words: int = WORDS) -> Iterator[tuple[int, bytes]]:
    """Distinct hashes dealt to slices of the filter, packed."""
    hashes = np.unique(hashes)
    part = _places(hashes, words) // (words // SLICES)
    order = np.argsort(part, kind="stable")
    hashes, part = hashes[order], part[order]
    edges = np.searchsorted(part, np.arange(SLICES + 1))
    for i in range(SLICES):
        if edges[i] < edges[i + 1]:
            yield i, hashes[edges[i] : edges[i + 1]].tobytes()


def build_filter(packed: DataFrame, words: int = WORDS) -> np.ndarray:
    """The filter of ``packed(slice, hashes)``; each executor task streams over its slices."""
    width = words // SLICES

    def merge(batches):
        parts = {}
        for batch in batches:
            for part, raw in zip(batch.column("slice").to_pylist(), batch.column("hashes"), strict=True):
                own = parts.setdefault(part, np.zeros(width, np.uint64))
                hashes = np.frombuffer(raw.as_buffer(), np.uint64)
                np.bitwise_or.at(own, _places(hashes, words) % width, _masks(hashes))
        for part, own in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["slice", "bits"])

    merged = packed.repartition(SLICES, "slice").mapInArrow(merge, "slice int, bits binary")
    out = np.zeros(words, np.uint64)
    for row in merged.toLocalIterator():
        out[row["slice"] * width : (row["slice"] + 1) * width] |= np.frombuffer(bytes(row["bits"]), np.uint64)
    return out


def passes(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    mask = _masks(hashes)
    return (bits[_places(hashes, len(bits))] & mask) == mask
