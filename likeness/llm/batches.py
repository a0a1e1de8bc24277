"""Arrow batches cut by bytes of text, so that a task's memory doesn't hang on the rows of a batch."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``limit`` bytes in a binary column; a longer row is alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def _trim():
    """glibc's malloc_trim; other C libraries have none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


_TRIM = _trim()


def release() -> None:
    """Give back what Arrow and the C library hold for later: the worker goes on to tasks of other queries."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]):
    """What a worker remembers from task to task, one thing at a time: that of the operator before is dropped."""
    if key not in _KEPT:
        _KEPT.clear()
        gc.collect()
        release()
        _KEPT[key] = make()
    return _KEPT[key]
