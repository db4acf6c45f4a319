"""Regular monthly series, decomposition and autocorrelation for any number of series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F


def calendar_fill(counts: DataFrame, keys: list[str], value: str, date: str = "date") -> DataFrame:
    """Every month between the first and the last one of each series, missing months as 0."""
    span = counts.groupBy(*keys).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    months = span.select(*keys, F.explode(F.expr("sequence(_a, _b, interval 1 month)")).alias(date))
    return months.join(counts, [*keys, date], "left").fillna(0, [value])


def prepare_series(national: DataFrame, value: str = "disaster_count", category: str | None = None,
                   by_category: bool = False) -> DataFrame:
    """Monthly sums as gapless series: all events together, one category, or one series per category."""
    picked = national.filter(F.col("disaster_category") == category) if category else national
    name = F.col("disaster_category") if by_category else F.lit(category or "all")
    sums = picked.groupBy(name.alias("series"), "date").agg(F.sum(value).alias(value))
    return calendar_fill(sums, ["series"], value)


def _in_order(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def difference(series: DataFrame, value: str, lags: tuple[int, ...] = (1, 12), keys=("series",), order: str = "date") -> DataFrame:
    w = _in_order(list(keys), order)
    return series.withColumns({f"diff_{k}": F.col(value) - F.lag(value, k).over(w) for k in lags})


def decompose(series: DataFrame, value: str, period: int = 12, keys=("series",), order: str = "date") -> DataFrame:
    """Additive decomposition: centred moving average, centred seasonal means, remainder."""
    keys = list(keys)
    w = _in_order(keys, order)
    whole = Window.partitionBy(*keys)
    half = period // 2
    if period % 2:
        trend = F.avg(value).over(w.rowsBetween(-half, half))
    else:
        trend = (F.avg(value).over(w.rowsBetween(-half, half - 1)) + F.avg(value).over(w.rowsBetween(1 - half, half))) / 2
    place = F.row_number().over(w)
    full = (place > half) & (F.count(F.lit(1)).over(whole) - place >= half)
    lined = series.withColumns({"trend": F.when(full, trend), "_slot": (place - 1) % period})
    per_slot = lined.groupBy(*keys, "_slot").agg(F.avg(F.col(value) - F.col("trend")).alias("_s"))
    centred = per_slot.withColumn("seasonal", F.col("_s") - F.avg("_s").over(whole)).drop("_s")
    return (lined.join(centred, [*keys, "_slot"]).withColumn("resid", F.col(value) - F.col("trend") - F.col("seasonal"))
            .drop("_slot"))


def acf(series: DataFrame, value: str, max_lag: int = 36, keys=("series",), order: str = "date") -> DataFrame:
    """Autocorrelation at lags 0..max_lag, as one aggregate over lagged columns."""
    keys = list(keys)
    w, whole = _in_order(keys, order), Window.partitionBy(*keys)
    centred = series.withColumn("_x", F.col(value) - F.avg(value).over(whole))
    shifted = centred.select(*keys, "_x", *[F.lag("_x", k).over(w).alias(f"_l{k}") for k in range(1, max_lag + 1)])
    sums = shifted.groupBy(*keys).agg(
        F.sum(F.col("_x") * F.col("_x")).alias("_v"), F.count(F.lit(1)).alias("_n"),
        *[F.sum(F.col("_x") * F.col(f"_l{k}")).alias(f"_c{k}") for k in range(1, max_lag + 1)])
    values = F.array(F.lit(1.0), *[F.try_divide(f"_c{k}", "_v") for k in range(1, max_lag + 1)])
    return (sums.select(*keys, "_n", F.posexplode(values).alias("lag", "acf"))
            .filter((F.col("lag") < F.col("_n"))).drop("_n"))


def stack_differences(series: DataFrame, value: str) -> DataFrame:
    """The series itself and its first and seasonal differences, as series of their own."""
    diffed = difference(series, value)
    parts = [diffed.select(F.concat("series", F.lit(suffix)).alias("series"), "date", F.col(c).cast("double").alias(value))
             for suffix, c in (("", value), (" diff", "diff_1"), (" sdiff", "diff_12"))]
    return reduce(lambda a, b: a.unionByName(b), parts).filter(F.col(value).isNotNull())
