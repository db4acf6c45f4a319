"""Cached inputs that are released by whoever asked for them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame


@contextmanager
def cached(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """``df`` cached inside the ``with`` block and released at its end, also when an error ends it.

    A frame that was cached before keeps its level and stays cached: its owner releases it. Results that are
    used after the block have to be written inside it.
    """
    owned = not (df.storageLevel.useMemory or df.storageLevel.useDisk)
    if owned:
        df.persist(level)
    try:
        yield df
    finally:
        if owned:
            df.unpersist()
