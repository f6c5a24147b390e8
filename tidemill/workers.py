"""Memory of Python workers: rows in short pieces, and what is free goes back to the machine."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa

#: Rows, and bytes about, that are turned into Python's own objects at once.
ROWS, BYTES = 256, 4 << 20
#: What mallopt() calls the size from which memory is taken from the machine by itself, and the number of arenas.
MMAP_THRESHOLD, ARENA_MAX = -3, -8
_c: list[ctypes.CDLL] = []


def release() -> None:
    """Give memory that is free in this worker back to the machine; the first call also has batches go back as soon as they are free."""
    if not _c:
        _c.append(ctypes.CDLL(None))
        pa.set_memory_pool(pa.system_memory_pool())
        if hasattr(_c[0], "mallopt"):
            _c[0].mallopt(MMAP_THRESHOLD, 1 << 16)
            _c[0].mallopt(ARENA_MAX, 1)
    pa.default_memory_pool().release_unused()
    if hasattr(_c[0], "malloc_trim"):
        _c[0].malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in pieces of so many rows, or of about size bytes where rows are long; of one row at least."""
    release()
    for batch in batches:
        step = max(1, min(rows, size * batch.num_rows // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
        release()
