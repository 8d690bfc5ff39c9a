"""Intermediate tables and files of this subpackage (see meshlake.functions.state), and what bounds a Python worker's memory."""

import ctypes
import functools
import gc

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlake.functions.state import discard, fresh_path, join_bounded, local_path, shared_dir, written

__all__ = ["discard", "fresh_path", "join_bounded", "join_keyed", "local_path", "shared_dir", "sliced", "tidy", "written"]

#: Keys with more than one in so many rows are hot. There are fewer of them than this, whatever the data.
HOT_KEYS = 100_000


def sliced(batches, rows: int = 256):
    """Arrow batches in slices, so that a worker turns few texts at a time into Python objects."""
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.slice(i, rows)


def join_keyed(rows: DataFrame, keys: DataFrame, on: list[str], n: str, total: int, hot_keys: int = HOT_KEYS) -> DataFrame:
    """``rows`` with the columns of ``keys``, which has one row a key and the number ``n`` of its rows, of ``total`` at most.

    Keys of more than total / hot_keys rows number fewer than hot_keys, so they are broadcast and their rows stay where they are. The others are
    joined by a shuffle, in which no key has more than that share of the rows."""
    share = max(1, total // hot_keys)
    hot = keys.where(F.col(n) > share)
    cold = keys.where(F.col(n) <= share)
    here = rows.join(F.broadcast(hot), on)
    there = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return here.unionByName(there)


def release() -> None:
    """Gives freed memory back to the machine: Arrow's pool and the C heap keep it otherwise, and Spark keeps idle workers alive beside later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have no such call
        return


def tidy(run):
    """A ``mapInArrow`` function that releases its memory when a task's last batch is done."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped
