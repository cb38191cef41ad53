"""Arrow batches of texts in slices of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def text_blocks(batches: Iterator[pa.RecordBatch], at: int, most: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their whole texts (column ``at``; null as empty), of ``most`` bytes or one text."""
    for whole in batches:
        lo, held, texts = 0, 0, []
        for hi, t in enumerate(whole.column(at).cast(pa.large_binary())):
            raw = t.as_buffer().to_pybytes() if t.is_valid else b""
            if texts and held + len(raw) > most:
                yield whole.slice(lo, hi - lo), texts
                lo, held, texts = hi, 0, []
            texts.append(raw)
            held += len(raw)
        if texts:
            yield whole.slice(lo), texts


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives memory that it has freed back to the machine: workers are used again, by
    tasks of other stages, and would hold the most that any of these took."""
    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return whole
