"""What Python workers keep from one task to the next.

Workers outlive tasks and the stages of a pipeline, so what an operator's tasks keep for each other would stay in memory while those of the next one run.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_forget: dict[str, Callable[[], None]] = {}
_owner: str | None = None


def keeps(owner: str, forget: Callable[[], None]) -> None:
    """``forget`` empties what the tasks of ``owner`` keep in a process."""
    _forget[owner] = forget


def begin(owner: str) -> None:
    """A task of ``owner`` begins: what others have kept goes, and freed memory is given back to the system."""
    global _owner
    if owner != _owner:
        _owner = owner
        for name, forget in _forget.items():
            if name != owner:
                forget()
        gc.collect()  # a cache and what fills it refer to each other
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)
