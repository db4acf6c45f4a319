"""Yearly increments that commit alone and can be merged later.

Each (year, batch) is reduced to counts of its values and written to a folder of its own, so a year that fails or is
empty leaves all others as they are. Counts of several batches add up, so exact medians follow from all increments
together without reading the raw rows again. A manifest lists what became of every batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.ordered import ordered_totals

_MANIFEST = "year int, batch string, seq int, status string, n_rows long, error string"


class YearStore:
    """State of the increments below ``path``, for rows with ``keys`` and a numeric ``value``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], value: str):
        self.spark, self.path, self.keys, self.value = spark, path.rstrip("/"), keys, value

    def add(self, year: int, read: Callable[[], DataFrame], batch: str = "all") -> str:
        """Load one batch of a year: ``loaded``, ``empty`` or ``failed``. The same batch replaces what it wrote before.

        Any error of Spark fails the batch and is written to the manifest with its message; the next call repairs it.
        """
        target = f"{self.path}/state/year={year}/batch={batch}"
        try:
            v = F.col(self.value).cast("double")
            counts = read().groupBy(*self.keys, v.alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
            counts.write.mode("overwrite").parquet(target)
            rows = self.spark.read.schema(counts.schema).parquet(target).agg(F.sum("n_rows")).first()[0] or 0
            status, error = ("loaded" if rows else "empty"), None
        except PySparkException as failure:
            status, rows, error = "failed", None, str(failure)[:500]
        seq = self.manifest(latest=False).filter((F.col("year") == year) & (F.col("batch") == batch)).count()
        self.spark.createDataFrame([(year, batch, seq, status, rows, error)], _MANIFEST).coalesce(1).write.mode("append").parquet(
            f"{self.path}/manifest")
        return status

    def manifest(self, latest: bool = True) -> DataFrame:
        """What became of every batch, or of every attempt. One row per attempt, so it stays small."""
        try:
            rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        except PySparkException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _MANIFEST)
        if not latest:
            return rows
        newest = Window.partitionBy("year", "batch").orderBy(F.desc("seq"))
        return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")

    def figures(self) -> DataFrame:
        """Rows, sum and exact median per key and year, over the batches that are loaded."""
        good = self.manifest().filter(F.col("status") == "loaded").select("year", "batch")
        keys = [*self.keys, "year"]
        # Only what the manifest calls loaded counts: a failed attempt may have left half a folder.
        state = self.spark.read.parquet(f"{self.path}/state").withColumns({"year": F.col("year").cast("int"), "batch": F.col("batch").cast("string")})
        counts = (state.join(good, ["year", "batch"], "left_semi").groupBy(*keys, "value").agg(F.sum("n_rows").alias("n_rows"))
                  .withColumn("n", F.when(F.col("value").isNotNull(), F.col("n_rows")).otherwise(0)))
        placed = ordered_totals(counts, keys, "value", ["n"])
        middle = (F.col("tot_n") - 1) / 2
        sides = [F.max(F.when((F.col("cum_n") - F.col("n") <= at) & (at < F.col("cum_n")), F.col("value"))).alias(side)
                 for side, at in (("_lo", F.floor(middle)), ("_hi", F.ceil(middle)))]
        return (placed.groupBy(*keys).agg(F.sum("n_rows").alias("n_records"), F.sum(F.col("value") * F.col("n")).alias("total"), *sides)
                .select(*keys, "n_records", "total", ((F.col("_lo") + F.col("_hi")) / 2).alias("median")))
