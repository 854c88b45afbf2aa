"""What a Python worker holds between tasks: one large object at a time, and texts in small parts.

Workers outlive tasks and serve one stage after another, so an object that every operator kept for
itself (a tokenizer, a table of chunks) would add up.
"""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa

_held: dict = {}
_last = 0.0
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only


def held(key: tuple, make: Callable[[], Any]) -> Any:
    """The object under key; any other is let go."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Lets go of what is held, and gives the memory back to the system."""
    global _last
    if _held or time.monotonic() > _last + 2:
        _held.clear()
        pa.default_memory_pool().release_unused()
        if _trim is not None:
            _trim(0)
        _last = time.monotonic()


def each(values: pa.Array, rows: int = 64) -> Iterator:
    """The values of an array as Python objects, a few at a time."""
    for i in range(0, len(values), rows):
        yield from values.slice(i, rows).to_pylist()


@contextmanager
def no_collector() -> Iterator[None]:
    """Without the cyclic garbage collector, which would walk all that is held again and again; for
    code that makes many objects and no cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()
