"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Settings every job relies on: UTC clocks, runtime re-planning, skew splitting.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


#: Folders that are deleted when the driver ends.
_registered: set[str] = set()


def build_session(app: str = "perilframe", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def joins_by_part_of_key(spark: SparkSession) -> Iterator[None]:
    """Inside, a join on several columns takes rows as they are dealt if that is by some of these columns.

    By default Spark deals them again by all columns, which saves it from few and uneven parts. Use it where the part of
    the key has many values, none of them hot.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def scratch_root(spark: SparkSession) -> str:
    """Folder for written intermediate tables.

    It is named in ``spark.checkpoint.dir`` and must be visible to every executor. Where that is unset, a
    folder of the warehouse takes its place, which has to be shared as well: on a cluster whose warehouse was left at
    Spark's default, a folder of the driver's own machine, this is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and warehouse.endswith(f"{os.getcwd()}/spark-warehouse"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    return f"{warehouse}/perilframe-scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder; two calls never collide.

    All paths of an application lie in one folder, which is deleted when its driver ends.
    """
    folder = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}"
    if folder not in _registered:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _registered.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}"
