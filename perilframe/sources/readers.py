"""Readers for landed files: delimited text, paged JSON, JSON matrices and macro series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions import columns as fc


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, **options) -> DataFrame:
    """Delimited text with a declared schema: ids stay text, unreadable numbers become NULL."""
    return spark.read.schema(schema).options(header=True, mode="PERMISSIVE", **options).csv(path)


def read_pages(spark: SparkSession, path: str, entity: str, record: str, multi_line: bool = False) -> DataFrame:
    """Rows of all page documents. One document per line is split across tasks by Spark; pages
    pretty-printed over several lines need ``multi_line`` and are read one file per task."""
    schema = f"metadata struct<count: bigint>, `{entity}` array<struct<{record}>>"
    pages = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    return pages.select(F.explode(F.col(f"`{entity}`")).alias("_r")).select("_r.*")


def page_completeness(spark: SparkSession, path: str, entity: str, record: str, multi_line: bool = False) -> DataFrame:
    """Announced and delivered row counts of a set of pages."""
    schema = f"metadata struct<count: bigint>, `{entity}` array<struct<{record}>>"
    pages = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    return pages.agg(
        F.max("metadata.count").alias("announced"),
        F.coalesce(F.sum(F.size(F.col(f"`{entity}`")).cast("long")), F.lit(0)).alias("delivered"),
    ).withColumn("complete", F.coalesce(F.col("announced") == F.col("delivered"), F.lit(False)))


def matrix_rows(documents: DataFrame, column: str, header: list[str], rename: dict[str, str],
                keep: list[str]) -> DataFrame:
    """Rows of JSON documents that hold an array of arrays whose first element is the header.

    ``header`` lists the names that may appear; their place is looked up in each document's own
    header row, so column order may differ between documents.
    """
    parsed = documents.select(F.from_json(column, "array<array<string>>").alias("_m"))
    cells = (parsed.select(F.element_at("_m", 1).alias("_h"), F.posexplode("_m").alias("_i", "_row"))
             .filter(F.col("_i") > 0))
    picked = cells.select(*[
        F.when(F.array_contains("_h", name),
               F.try_element_at("_row", F.array_position("_h", name).cast("int"))).alias(rename.get(name, name))
        for name in header])
    return picked.select(*keep)


def demographics(matrix: DataFrame, variables: list[str]) -> DataFrame:
    """Compose the county key and turn the variables into numbers."""
    return matrix.select(fc.compose_key("state", "county").alias("county_fips"), "NAME",
                         *[fc.number(v).alias(v) for v in variables])


def read_macro_csv(spark: SparkSession, path: str, series: str, date_names=("DATE", "observation_date")) -> DataFrame:
    """One macro series; the date column may carry either name and "." marks a missing value."""
    raw = spark.read.options(header=True, inferSchema=False, nullValue=".").csv(path)
    name = next(c for c in (*date_names, "date") if c in raw.columns)
    return raw.select(F.col(name).try_cast("date").alias("date"), fc.number(series).alias(series))


def pushed_scan(spark: SparkSession, path: str, columns: list[str], predicate) -> DataFrame:
    """Filter and column list that reach the Parquet scan."""
    return spark.read.parquet(path).filter(predicate).select(*columns)


def optional_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty frame of the same schema when nothing has been landed there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if found else spark.createDataFrame([], schema)
