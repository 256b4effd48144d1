"""Memory of Python workers, which live on from job to job with what their allocators hold."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Return unused memory of Arrow and of the C library to the system; a library without ``malloc_trim`` keeps its own."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
