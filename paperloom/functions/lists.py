"""Lists of words in Arrow batches: a Python object stands for a different word of a slice, never for each word of a text."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def lengths(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose lists in ``column`` have ``most`` values together, or one longer row."""
    ends = np.cumsum(lengths(batch.column(column)))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def replaced(lists: pa.ListArray, replace: Callable[[str], list], kind: pa.DataType) -> pa.ListArray:
    """The lists with the values of ``replace`` in the place of each word; equal words are replaced once."""
    kinds = lists.flatten().dictionary_encode()
    parts = [replace(w) for w in kinds.dictionary.to_pylist()]
    place, sizes = kinds.indices.to_numpy(), np.array([len(p) for p in parts], np.int64)
    begin, number = np.cumsum(sizes) - sizes, sizes[place]
    ends = np.cumsum(number)
    # Values of a word lie together in ``flat``: the distance of their place there to that in the lists is the same for all.
    at = np.repeat((begin[place] - (ends - number)).astype(np.int32), number)
    at += np.arange(len(at), dtype=np.int32)
    flat = pa.array([v for p in parts for v in p], kind)
    edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths(lists))])]
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), flat.take(pa.array(at)), mask=lists.is_null())
