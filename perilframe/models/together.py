"""Independent fits at the same time.

A fit on little data is a chain of many short jobs, which leaves most cores idle. Fits that do not depend on each other are
started from a bounded pool of driver threads, so their jobs share the cluster. Only models and metrics stay on the driver.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

R = TypeVar("R")

#: Fits under way at once. Each holds its training rows in the cache and one tree's histograms on the driver.
AT_ONCE = 8
#: Training rows of one task.
ROWS_PER_TASK = 20_000
#: Training rows that a task holds at most.
MOST_ROWS = 1_000_000
#: Fits that share the cores with the one of this thread, itself included.
_beside = threading.local()


def together(jobs: Iterable[Callable[[], R]], at_once: int = AT_ONCE) -> list[R]:
    """Results of ``jobs``, which begin in their order; the first error is raised once all have ended."""
    jobs = list(jobs)
    begun = [threading.Event() for _ in jobs]

    def in_turn(place: int) -> R:
        if place:
            begun[place - 1].wait()
        begun[place].set()
        return jobs[place]()

    # Wrapped here, so that every thread starts with the local properties of the caller.
    wrapped = [inheritable_thread_target(lambda place=place: in_turn(place)) for place in range(len(jobs))]
    if len(wrapped) < 2:
        return [job() for job in wrapped]
    threads = min(at_once, len(wrapped))

    def share() -> None:
        _beside.fits = threads

    def run(place: int) -> R:
        try:
            return wrapped[place]()
        finally:
            begun[place].set()

    with ThreadPoolExecutor(threads, initializer=share) as pool:
        return [future.result() for future in [pool.submit(run, place) for place in range(len(jobs))]]


def beside() -> int:
    """Fits that share the cluster with the one of this thread, itself included."""
    return getattr(_beside, "fits", 1)


def storage_memory(spark: SparkSession) -> int:
    """Bytes that all executors have for cached rows and for work."""
    found = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().values().iterator()
    total = 0
    while found.hasNext():
        total += found.next()._1()
    return total


def sized(rows: DataFrame, per_task: int = ROWS_PER_TASK, fits: int | None = None) -> DataFrame:
    """``rows`` in as many even partitions as their number asks for, but no more than a fit has cores.

    A fit runs thousands of short stages. Tasks beyond one a core only add their start to each, and in a forest another
    copy of the histograms of all open nodes to the shuffle. ``fits`` that run at once (by default those of ``together``)
    have two tasks a core between them. Partitions grow in number again where one would hold more than ``MOST_ROWS``.
    """
    fits = fits or beside()
    count, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    most = cores if fits == 1 else -(-2 * cores // fits)
    wanted = max(1, min(-(-count // per_task), most), -(-count // MOST_ROWS))
    return rows.coalesce(1) if wanted == 1 else rows.repartition(wanted)
