"""Running totals over an order too large for one task.

``Window.orderBy`` without a partition key, or with one hot key, sorts everything in a single task.
Here the keyed, ordered rows are range-partitioned on (keys, order) and written to a table in the scratch
folder, together with the number of the partition each row is in. Every part of a key is then summed on its
own, and the totals of the parts before it are added. All sizes and keys take this one path. The cut is fixed
by the written table, so every branch of the plan, and every task that is run again after an executor is
lost, sees the same one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import scratch_path
from ..sources.sinks import write_stage


def ordered_totals(df: DataFrame, keys: list[str], order: str, measures: list[str],
                   parts: int | None = None) -> DataFrame:
    """Add ``cum_<m>`` (inclusive running total by ascending ``order``) and ``tot_<m>`` per key.

    ``df`` holds one row per (keys, order); aggregate to that first. ``order`` may be any orderable
    column, a struct included. ``parts`` is the number of ranges; by default Spark takes its number of
    shuffle partitions, and joins ranges that are small. The table of totals has one row per key and range
    that holds some of it, so at most keys + ranges rows.
    """
    outer = [F.col(c) for c in df.columns]
    cut = [*[F.col(k) for k in keys], F.col(order)]
    ranged = df.repartitionByRange(parts, *cut) if parts else df.repartitionByRange(*cut)
    written = write_stage(ranged.withColumn("_part", F.spark_partition_id()), scratch_path(df.sparkSession, "ordered"))
    # Null keys are groups like any other, so a struct stands for the key: structs with null fields are equal.
    keyed = written.withColumn("_key", F.struct(F.lit(0).alias("_all"), *keys))
    whole = Window.partitionBy("_key")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = keyed.groupBy("_key", "_part").agg(*[F.sum(m).alias(m) for m in measures]).select(
        "_key", "_part", *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_before_{m}") for m in measures],
        *[F.sum(m).over(whole).alias(f"_total_{m}") for m in measures])
    running = Window.partitionBy("_key", "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return keyed.join(totals, ["_key", "_part"]).select(
        *outer, *[(F.sum(m).over(running) + F.col(f"_before_{m}")).alias(f"cum_{m}") for m in measures],
        *[F.col(f"_total_{m}").alias(f"tot_{m}") for m in measures])


def positions(df: DataFrame, keys: list[str], order: list[Column], name: str = "position",
              **options) -> DataFrame:
    """1-based place of each row in the order of ``order`` within ``keys``; ``order`` must be unique."""
    ranked = (df.withColumn("_order", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
              .withColumn("_one", F.lit(1).cast("long")))
    return (ordered_totals(ranked, keys, "_order", ["_one"], **options)
            .withColumnRenamed("cum__one", name).drop("_order", "_one", "tot__one"))


def grouped_stats(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float],
                  sums: dict[str, Column] | None = None, **options) -> DataFrame:
    """Exact interpolated quantiles of ``value`` per key, with count, sum, extremes and further sums.

    Equal values are counted before they are ordered, so neither a hot key nor a hot value gathers in
    one task. All figures come from the one ordered pass: ``n_rows`` (all rows), ``n`` (known values),
    ``total``, ``low``, ``high``, the quantiles, and one column per entry of ``sums``.
    """
    sums = sums or {}
    counted = (df.groupBy(*keys, F.col(value).cast("double").alias("_v"))
               .agg(F.count(value).alias("_c"), F.count(F.lit(1)).alias("_rows"),
                    *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()]))
    placed = ordered_totals(counted, keys, "_v", ["_c"], **options)
    picks = []
    for name, q in quantiles.items():
        at = F.lit(float(q)) * (F.col("tot__c") - 1)
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("cum__c") - F.col("_c") <= pos) & (pos < F.col("cum__c"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}_{name}"))
    picked = placed.groupBy(*keys).agg(
        F.sum("_rows").alias("n_rows"), F.sum("_c").alias("n"), F.sum(F.col("_v") * F.col("_c")).alias("total"),
        F.min("_v").alias("low"), F.max("_v").alias("high"), *picks,
        *[F.sum(f"_s_{n}").alias(n) for n in sums])
    out = []
    for name, q in quantiles.items():
        at = F.lit(float(q)) * (F.col("n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return picked.select(*keys, "n_rows", "n", "total", "low", "high", *out, *sums)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float],
                    **options) -> DataFrame:
    """Linearly interpolated quantiles per key, exact for groups of any size."""
    known = df.filter(F.col(value).isNotNull())
    return grouped_stats(known, keys, value, quantiles, **options).select(*keys, *quantiles)


def with_quantiles(aggregated: DataFrame, df: DataFrame, keys: list[str], value: str,
                   quantiles: dict[str, float], **options) -> DataFrame:
    """Attach quantile columns to an aggregate over the same keys."""
    return aggregated.join(exact_quantiles(df, keys, value, quantiles, **options), keys, "left")
