"""What a Python worker keeps between tasks: one thing at a time.

Spark reuses workers for all stages of an application, so a table that a stage keeps in its module would stay beside
those of the stages after it. Here a stage's own thing takes the place of the last one's.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

_now: tuple[Hashable, Any] = (None, None)


def trim() -> None:
    """Give memory that nothing holds any more back to the system, where the C library can."""
    gc.collect()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def release() -> None:
    """Drop what is kept."""
    global _now
    if _now[0] is None:
        return
    _now = (None, None)
    trim()


def held(key: Hashable, build: Callable[[], Any]) -> Any:
    """The thing of that key, built if another one, which is then dropped, or none is kept."""
    global _now
    if _now[0] != key:
        release()
        _now = (key, build())
    return _now[1]
