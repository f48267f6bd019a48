"""Memory of Python workers, which Spark uses again for later tasks and stages."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def give_back() -> None:
    """Return what this process has freed to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, that gives freed memory back after each result and when its task ends.

    A worker that waits would otherwise keep what an earlier stage has freed beside the tasks of later ones.
    """

    @wraps(run)
    def given_back(batches: Iterator) -> Iterator:
        for out in run(batches):
            yield out
            del out
            give_back()
        give_back()

    return given_back
