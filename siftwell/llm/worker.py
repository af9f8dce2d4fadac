"""What a Python worker keeps between tasks. Workers live on from one operator to the next."""

from __future__ import annotations

import ctypes

import pyarrow as pa

_KEPT: dict[str, dict] = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def begin(kind: str) -> dict:
    """What tasks of this kind keep; what other kinds kept is dropped, and free memory goes back to the system."""
    for other in [k for k in _KEPT if k != kind]:
        del _KEPT[other]
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)
    return _KEPT.setdefault(kind, {})
