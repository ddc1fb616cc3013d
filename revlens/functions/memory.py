"""What Python workers keep of freed memory."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Returns to the system what Arrow and the C library keep of freed memory: a worker outlives its stage, and those
    of an executor share one limit."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)
