"""Operators for training-data pipelines. Nothing outside this folder imports them."""

import ctypes
import gc

import pyarrow as pa

# A worker lives as long as its executor and runs every operator: buffers of a megabyte or more go back to the machine
# when they are free, instead of staying with the worker. (-3 is glibc's M_MMAP_THRESHOLD; other libraries lack it.)
pa.set_memory_pool(pa.system_memory_pool())
try:
    ctypes.CDLL(None).mallopt(-3, 1 << 20)
except (AttributeError, OSError, TypeError):
    pass

#: Large things that a worker keeps from one task to the next, for operators that make them at some cost.
KEPT: dict = {}


def forget() -> None:
    """What other operators' tasks left in this worker goes, and its memory back to the machine. Tasks that are large
    themselves call it, so that a worker which runs a whole pipeline never holds both."""
    if KEPT:
        KEPT.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError, TypeError):
            pass
