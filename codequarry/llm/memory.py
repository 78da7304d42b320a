"""Python workers live on between tasks: what a task has freed goes back to the system when it ends."""

from __future__ import annotations

import ctypes
from functools import lru_cache

import pyarrow as pa


@lru_cache(maxsize=1)
def _trim():
    """The C library's call that returns freed memory, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def release() -> None:
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def frugal(run):
    """``run`` (batches -> batches), with freed memory given back at its end."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
