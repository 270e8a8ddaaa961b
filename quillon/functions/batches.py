"""Arrow batches in bounded parts, for Python that makes objects of their texts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it


def release() -> None:
    """Hands freed memory back to the system: a worker lives on after its task, and its allocators keep what they once held."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def parts(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that the texts of ``column`` have about ``most`` bytes in each (a longer text alone); freed memory is handed back after every batch."""
    for batch in batches:
        begin = held = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if i > begin and held + n > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < batch.num_rows:
            yield batch.slice(begin)
        del batch
        release()
