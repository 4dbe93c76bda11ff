"""Memory of Python workers, which Spark uses again for other operators' tasks."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable

import pyarrow as pa

_forgets: list[Callable[[], None]] = []
_now: list[str] = [""]


def keeps(forget: Callable[[], None]) -> None:
    """Says how to give up what a module keeps between tasks."""
    _forgets.append(forget)


def begins(operator: str) -> None:
    """At the start of a task: what another operator has kept here goes."""
    if _now[0] != operator:
        if _now[0]:
            for forget in _forgets:
                forget()
            ends()
        _now[0] = operator


def ends() -> None:
    """At the end of a task: memory that isn't used goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do it by themselves or not at all
        ctypes.CDLL("libc.so.6").malloc_trim(0)
