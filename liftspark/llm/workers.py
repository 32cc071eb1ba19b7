"""What a Python worker keeps between tasks.

Workers outlive a task and serve one operator after the other, so that tables
of one would stand beside those of the next. A worker holds one object at a
time, and hands freed memory back to the system when a task ends. Heaps of the
JVMs keep what they once grew to, until a full collection shrinks them.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_held: dict[object, object] = {}


_TRIM, _MMAP = -1, -3  # parameters of mallopt


@lru_cache(maxsize=1)
def _allocator():
    """The C library's malloc_trim, after telling it to keep little of what is freed: by default its limits grow with use."""
    try:
        c = ctypes.CDLL(None)
        c.mallopt(_MMAP, 8 << 20)
        c.mallopt(_TRIM, 8 << 20)
        return c.malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda _: 0


def hand_back() -> None:
    pa.default_memory_pool().release_unused()
    _allocator()(0)


def hold(key: object, make: Callable[[], object]) -> object:
    """The object of this key, made if the worker doesn't hold it; any other is let go first."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    if _held:
        _held.clear()
        gc.collect()
        hand_back()


def task(run, holds: bool = False):
    """A function over batches that starts with nothing held by others, unless it holds something itself, and hands back memory."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _allocator()
        if not holds:
            let_go()
        try:
            yield from run(batches)
        finally:
            hand_back()

    return wrapped


def shrink_heaps(spark: SparkSession) -> None:
    """Executors collect their garbage, which shrinks their heaps, before a stage that needs memory outside them.

    There is a task for each core, so that idle executors get some each; one without any keeps a larger heap, nothing else."""
    cores = spark.sparkContext.defaultParallelism
    collected = F.expr("java_method('java.lang.System', 'gc')").alias("collected")
    spark.range(0, cores, 1, cores).select(collected).write.format("noop").mode("overwrite").save()
