"""Vectors in Arrow columns as numpy matrices, and back as packed rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def finite(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length above 0 of the vectors: their places and their matrix as double.

    Vectors that are null or hold null or non-finite components are left out.
    """
    if not len(column) or not (pa.types.is_list(column.type) or pa.types.is_large_list(column.type)):
        return
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    flat = np.asarray(pc.fill_null(pc.cast(pc.list_flatten(column), pa.float64()), np.nan))
    start = np.cumsum(size) - size
    for d in np.unique(size[size > 0]):
        at = np.flatnonzero(size == d)
        m = flat[start[at][:, None] + np.arange(d)]
        ok = np.isfinite(m).all(1)
        if ok.any():
            yield at[ok], m[ok]


def packed(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as one binary value each."""
    m = np.ascontiguousarray(m)
    width = m.shape[1] * m.itemsize
    offsets = pa.py_buffer(np.arange(0, (len(m) + 1) * width, width, dtype=np.int64)[: len(m) + 1].tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(m), [None, offsets, pa.py_buffer(m.tobytes())]).cast(pa.binary())
