"""Arrow batches in pieces, so that what a kernel holds follows from a bound and not from the table."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def pieces(batch: pa.RecordBatch, sizes: pa.Array, most: int, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Whole rows in their order, up to a total size and a number of rows at a time; a larger row comes alone. Nulls have no size."""
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(batch):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        if rows is not None:
            stop = min(stop, start + rows)
        yield batch.slice(start, stop - start)
        start = stop


def tidy(kernel: Kernel) -> Kernel:
    """The kernel, which gives freed memory back to the system after a partition: workers live on and share an executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return run
