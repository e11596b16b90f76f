"""Arrow batches in workers: texts a bounded number of bytes at a time, and memory given back."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text in one lot.
BATCH = 2_000_000


def batches(it: Iterator[pa.RecordBatch], column: str, most: int = BATCH) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Arrow batches cut to about ``most`` bytes of text, with the texts as UTF-8 (null: empty).

    Only one lot's texts are copied at a time.
    """
    for batch in it:
        texts = batch.column(column).cast(pa.binary())
        if not len(texts):
            continue
        ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
        start = 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
            yield batch.slice(start, stop - start), [x or b"" for x in texts.slice(start, stop - start).to_pylist()]
            start = stop


def decoded(text: bytes) -> str:
    """A text's characters; malformed UTF-8 reads as U+FFFD, as Python's ``replace`` has it."""
    return text.decode(errors="replace")


def released(run: Callable) -> Callable:
    """``run`` for a task; the memory that the task freed goes back to the system at its end, for the worker lives on."""

    def task(*args):
        try:
            yield from run(*args)
        finally:
            give_back()

    return task


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        return
