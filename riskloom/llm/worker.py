"""What a Python worker keeps from one task to the next, and the threads it takes."""

from __future__ import annotations

import ctypes
import glob
import os
from collections.abc import Callable, Hashable

import numpy as np
import pyarrow as pa

# Names under which builds of OpenBLAS set the number of their threads.
_SETTERS = (
    "openblas_set_num_threads",
    "openblas_set_num_threads64_",
    "scipy_openblas_set_num_threads",
    "scipy_openblas_set_num_threads64_",
)
_kept: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], object]):
    """The object made under this key. Workers are used again by later tasks, also those of other
    operators: what another one has left goes first, so that a worker never holds two."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def release_memory() -> None:
    """Give freed memory back, where the C library can: workers that wait would hold it for good."""
    pa.default_memory_pool().release_unused()
    library = ctypes.CDLL(None)
    if hasattr(library, "malloc_trim"):
        library.malloc_trim(0)


def one_blas_thread() -> None:
    """Keep the matrix products of this process to one thread, where numpy brings OpenBLAS along.

    Spark runs a task on each core already; more threads wait for each other on small matrices and
    cost several times the CPU time.
    """
    folder = os.path.join(os.path.dirname(os.path.dirname(np.__file__)), "numpy.libs")
    for path in glob.glob(os.path.join(glob.escape(folder), "*openblas*")):
        library = ctypes.CDLL(path)
        for name in _SETTERS:
            if hasattr(library, name):
                getattr(library, name)(1)
                break
