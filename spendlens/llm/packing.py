"""Sorted multisets of small non-negative ints, one a row, as bytes (gaps; 255 carries on)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack_multisets(row: np.ndarray, value: np.ndarray, n_rows: int, size: int) -> pa.Array:
    """Binary column of the values (below ``size``) of each row, in ascending order."""
    key = np.sort(row * np.int64(size) + value)
    row, value = key // size, key % size
    gap = np.diff(value, prepend=0)
    first = np.searchsorted(row, np.arange(n_rows + 1))
    heads = first[:-1][first[:-1] < first[1:]]
    gap[heads] = value[heads]
    width = gap // 255 + 1
    ends = np.cumsum(width)
    out = np.full(int(ends[-1]) if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = gap % 255
    offsets = np.concatenate([[0], ends])[first].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), n_rows, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpack_multisets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of all rows, bounds of the rows into them) of the bytes ``pack_multisets`` made."""
    run = np.cumsum(data, dtype=np.int64)
    at = np.flatnonzero(data != 255)
    bounds = np.searchsorted(at, offsets)
    before = np.concatenate([[0], run])[offsets[:-1]]
    return run[at] - np.repeat(before, np.diff(bounds)), bounds
