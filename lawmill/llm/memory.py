"""Memory of Python workers, which Spark uses again for later tasks and stages."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa


def give_back() -> None:
    """Hand memory that a task has freed back to the machine; else a worker keeps the most that any of its tasks took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)
