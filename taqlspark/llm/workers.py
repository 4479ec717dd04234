"""What Python workers do between tasks. They live on in their executors and serve all later steps."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator


def release() -> None:
    """Give memory that a task has freed back to the system: Arrow's pool, and the C library's where it can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy[T](run: Callable[[Iterator[T]], Iterator[T]]) -> Callable[[Iterator[T]], Iterator[T]]:
    """A step over batches that calls ``release`` once its task has ended, however it ends."""

    @functools.wraps(run)
    def tidied(batches: Iterator[T]) -> Iterator[T]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied
