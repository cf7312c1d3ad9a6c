"""Memory that Python workers give back between tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

Batches = Iterator[pa.RecordBatch]
#: What a worker keeps from task to task, by name: how to forget it.
_KEPT: dict[str, Callable[[], None]] = {}


def kept(name: str, forget: Callable[[], None]) -> None:
    """Register something that tasks load once in a worker; tasks that do not ask for it by name have it forgotten."""
    _KEPT[name] = forget


def release() -> None:
    """Hand freed memory back to the system, where the C library can (glibc)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(run: Callable[[Batches], Batches], *keeps: str) -> Callable[[Batches], Batches]:
    """``run`` for ``mapInArrow`` or an Arrow UDF, with ``release`` at its end.

    A worker outlives its task and stays beside the workers and the JVM of later stages,
    so what the allocator only keeps in store would count against their memory, and so would what
    tasks of another kind have loaded; only what ``keeps`` names stays.
    """

    def task(batches: Batches) -> Batches:
        for name, forget in list(_KEPT.items()):
            if name not in keeps:
                forget()
        yield from run(batches)
        release()

    return task
