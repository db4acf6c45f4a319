"""Writers for stage tables and incremental year partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_stage(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                **options) -> DataFrame:
    """Write a stage table and return it as read back, so later stages start from the files."""
    if fmt == "parquet":
        options = {"compression": "zstd", **options}
    writer = df.write.mode("overwrite").options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)
    return df.sparkSession.read.schema(df.schema).options(**options).format(fmt).load(path)


def overwrite_years(df: DataFrame, path: str, column: str = "year") -> None:
    """Replace only the years present in ``df``; other year partitions stay as they are.

    Rows are dealt by year, and Spark splits what is too much for one task, so files follow the volume.
    """
    (df.hint("rebalance", F.col(column)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(column).parquet(path))


def read_years(spark: SparkSession, path: str, years: list[int], column: str = "year") -> DataFrame:
    """Partition-pruned read of some years."""
    table = spark.read.parquet(path)
    return table.filter(table[column].isin(years))
