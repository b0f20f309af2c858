"""What Python workers do between tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # not glibc
    _trim = None


def give_back() -> None:
    """Return freed memory to the system, as a worker lives on for other tasks, of other stages too."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batch: pa.RecordBatch, sizes: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of neighbouring rows, in order. sizes: of each row (null: 0); a slice has about `most` of them
    together, and less than twice that, unless a single row has more."""
    ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), batch.num_rows]
    for i, j in zip(cuts, cuts[1:], strict=False):
        if i < j:
            yield batch.slice(i, j - i)
