"""What a Python worker keeps from task to task: the tables of the kind of work it did last."""

from __future__ import annotations

import ctypes
import gc

_LAST: list[dict] = []


def turn_to(tables: dict) -> None:
    """From now on the worker keeps ``tables``, which its current kind of work fills.

    Spark uses a worker again for other stages, beside an executor that needs
    the memory; so what another kind of work has kept is let go.
    """
    if _LAST and _LAST[0] is tables:
        return
    for old in _LAST:
        old.clear()
        hand_back()
    _LAST[:] = [tables]


def hand_back() -> None:
    """Give what was freed back to the system, where the C library can."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
