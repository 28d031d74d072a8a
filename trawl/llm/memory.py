"""Handing memory back between batches, so that idle Python workers stay small."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def release() -> None:
    """Return what Arrow's pool and the C library hold unused to the system, where they can."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass
