"""Arrow and numpy helpers that the text operators run inside tasks."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20


def give_back() -> None:
    """Return freed memory to the system: a worker waits for its next task without what the last one needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def texts_of(column) -> pa.Array:
    """A string array with nulls as empty texts, whose characters begin its buffer: some of Arrow's string functions are
    wrong on a slice from the middle of one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    first = np.frombuffer(texts.buffers()[1], np.int64, 1, texts.offset * 8)[0] if len(texts) else 0
    return texts.take(pa.array(np.arange(len(texts)))) if first or texts.offset else texts


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, cut so that the texts of a slice hold at most `most` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def flat(lists) -> tuple[pa.Array, np.ndarray]:
    """The non-empty strings of a list array and, per row, where its strings begin; one end more than rows."""
    values = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(values), 0)
    if pc.all(full).as_py() is False:
        mask = full.to_numpy(zero_copy_only=False)
        kept = np.concatenate([[0], np.cumsum(mask)])
        return values.filter(full), kept[offsets]
    return values, offsets


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of characters other than space and U+0009 to U+000D."""
    return flat(pc.ascii_split_whitespace(texts))


def coded(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct values and the index of each value among them."""
    encoded = values.dictionary_encode()
    return encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def hashes_of(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes, the same in every process."""
    if not len(distinct):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(distinct.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each row's values."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each value."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values, type=kind)
