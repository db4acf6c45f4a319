"""Train/test splits, folds and samples. All are deterministic functions of the row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import columns as fc


def temporal(df: DataFrame, cut: int, year: str = "year", name: str = "split") -> DataFrame:
    return df.withColumn(name, F.when(F.col(year) <= cut, "train").when(F.col(year) > cut, "test"))


def tail_months(series: DataFrame, months: int, date: str = "date", keys: list[str] | None = None) -> DataFrame:
    """The last ``months`` months of each series are the test part."""
    end = F.max(date).over(Window.partitionBy(*(keys or [F.lit(0)])))
    return series.withColumn("split", F.when(F.col(date) <= F.add_months(end, -months), "train").otherwise("test"))


#: Hex digits of the shuffle key that form a slice: 65,536 slices of equal expected size.
SLICE_DIGITS = 4


def shuffled_place(df: DataFrame, keys: list[str], seed: int = 42, within: list[str] | None = None,
                   name: str = "place") -> DataFrame:
    """1-based place of each row in a shuffled order, within each class if ``within`` is given.

    The shuffle key is a hash, so its leading digits cut the rows into even slices, hot classes
    included. Rows are numbered inside their slice and shifted by the size of the slices before it;
    the joined side has one row per slice and class.
    """
    groups = within or []
    hashed = df.withColumn("_h", fc.random_order(*keys, seed=seed)).withColumn("_slice", F.substring("_h", 1, SLICE_DIGITS))
    sizes = hashed.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_slice")
    offsets = sizes.select(*groups, "_slice", (F.sum("_n").over(before) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy(*groups, "_slice").orderBy("_h", *keys)
    return (hashed.join(offsets, [*groups, "_slice"])
            .withColumn(name, F.row_number().over(inside) + F.col("_before")).select(*df.columns, name))


def kfold(df: DataFrame, keys: list[str], k: int, seed: int = 42, within: list[str] | None = None,
          name: str = "fold") -> DataFrame:
    """Shuffled folds of equal size; with ``within``, equal inside each class as well."""
    placed = shuffled_place(df, keys, seed, within, "_place")
    return placed.withColumn(name, (F.col("_place") % k + 1).cast("int")).drop("_place")


def expanding(series: DataFrame, k: int, order: str = "date", keys: list[str] | None = None) -> DataFrame:
    """k growing training windows, each followed by an equally long test window.

    Rows of a series are bounded by its calendar; the result repeats a row once per fold it is part of.
    """
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    numbered = series.withColumns({"_place": F.row_number().over(whole.orderBy(order)) - 1,
                                   "_n": F.count(F.lit(1)).over(whole)})
    length = F.floor(F.col("_n") / (k + 1))
    folds = numbered.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    start = F.col("_n") - (k - F.col("fold")) * length
    part = F.when(F.col("_place") < start, "train").when(F.col("_place") < start + length, "test")
    return folds.withColumn("split", part).filter(F.col("split").isNotNull()).drop("_place", "_n")


def leave_one_out_sizes(df: DataFrame, group: str, label: str, min_rows: int = 50, min_positive: int = 10,
                        held_out: Column | None = None) -> DataFrame:
    """Fold sizes when each group in turn is held out; groups too small or one-sided are left out.

    Rows of groups that ``held_out`` excludes, and of no group, train in every fold. Computed from one row per
    group: no row is copied into the folds it trains.
    """
    every = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_test"), F.sum(label).alias("positives"), F.avg(label).alias("pos_rate_test"))
    whole = every.agg(F.sum("n_test")).scalar()
    sizes = every.filter(F.col(group).isNotNull() & (F.lit(True) if held_out is None else held_out))
    valid = (F.col("n_test") >= min_rows) & (F.col("positives") >= min_positive) & (F.col("positives") < F.col("n_test"))
    return sizes.withColumn("n_train", whole - F.col("n_test")).filter(valid)


def sample(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same ones on every run; each task keeps its own best n only."""
    return (df.withColumn("_r", fc.random_order(*keys, seed=seed)).orderBy("_r", *keys).limit(n).drop("_r"))
