"""Memory of executors: their heaps and their Python workers outlive a stage, and keep what it made them hold."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spanwarden.llm.pieces import release


def trim() -> None:
    """Gives free memory of Arrow and, where the C library can, of the process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def settle(spark: SparkSession) -> None:
    """Executors collect their garbage, after which their heaps shrink to a few times what is in use.

    A heap that one stage made grow may stay so otherwise, beside the next one's workers. A task for
    each core reaches every executor that is idle; one that it misses only keeps its memory.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs started meanwhile send at most ``rows`` rows at once to Python: both sides hold whole batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidy(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``f`` for ``mapInArrow``: vocabularies of earlier stages go before it, free memory after it."""

    @functools.wraps(f)
    def run(batches: Iterator) -> Iterator:
        release()
        try:
            yield from f(batches)
        finally:
            trim()

    return run
