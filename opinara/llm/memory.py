"""Memory of reused Python workers."""

from __future__ import annotations

import ctypes

import pyarrow as pa

try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # no glibc
    _trim = None


def release() -> None:
    """Give freed memory back at the end of a task: the worker process stays for later tasks."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)
