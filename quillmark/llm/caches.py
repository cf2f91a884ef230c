"""A worker process serves many operators in turn: only the latest one's cache stays in its memory."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_clear: dict[str, Callable[[], None]] = {}


def give_back() -> None:
    """Return free memory to the system: Arrow's pool, and what the C library keeps between blocks that are still used."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def claim(owner: str, clear: Callable[[], None]) -> None:
    """``owner`` is going to fill its cache: the others' are emptied and their memory is given back."""
    if owner not in _clear or len(_clear) > 1:
        for name, f in list(_clear.items()):
            if name != owner:
                f()
                del _clear[name]
        _clear[owner] = clear
        gc.collect()
        give_back()
