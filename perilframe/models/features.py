"""Feature frames for the models: scaling, indicators, imputation and assembly."""

from __future__ import annotations

from functools import reduce

from pyspark import SparkContext
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import columns as fc
from ..functions import fixed_values as fv
from ..operators.ordered import exact_quantiles, ordered_totals


def scale_units(df: DataFrame, divisors: dict[str, float] = fv.UNIT_DIVISORS) -> DataFrame:
    return df.withColumns({c: F.col(c) / d for c, d in divisors.items() if c in df.columns})


def region_dummies(df: DataFrame, column: str = "fema_region", values=fv.REGIONS) -> DataFrame:
    """One 0/1 column per listed value; the baseline 0 has none."""
    return df.withColumns({f"{column}_{v}": fc.indicator(column, v) for v in values})


def available(df: DataFrame, wanted: list[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def with_all(df: DataFrame, wanted: list[str]) -> DataFrame:
    """All wanted columns as doubles; absent ones become 0."""
    return df.withColumns({c: F.col(c).cast("double") if c in df.columns else F.lit(0.0) for c in wanted})


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact medians of many columns in one ordered pass over (column, value) counts."""
    tall = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "value")
    rows = exact_quantiles(tall, ["feature"], "value", {"median": 0.5}).collect()  # one row per feature
    # A column without any value has no row there.
    return dict.fromkeys(columns) | {r["feature"]: r["median"] for r in rows}


def medians_without(df: DataFrame, columns: list[str], group: str, values: list) -> dict:
    """For each value of ``group``: the medians of all rows outside it.

    One ordered pass serves every fold: each (column, value) pair carries one count per fold, and the
    running totals of all counts are taken together. No row is copied into the folds it belongs to.
    """
    tall = (df.select(F.col(group).alias("_g"), *[F.col(c).cast("double").alias(c) for c in columns])
            .unpivot(["_g"], columns, "feature", "value").filter(F.col("value").isNotNull()))
    names = [f"c{i}" for i in range(len(values))]
    counted = tall.groupBy("feature", "value").agg(
        *[F.count_if(F.coalesce(F.col("_g") != v, F.lit(True))).alias(n) for n, v in zip(names, values)])
    placed = ordered_totals(counted, ["feature"], "value", names)
    picks = []
    for n in names:
        at = (F.col(f"tot_{n}") - 1) / 2
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col(f"cum_{n}") - F.col(n) <= pos) & (pos < F.col(f"cum_{n}"))
            picks.append(F.max(F.when(hit, F.col("value"))).alias(f"{side}_{n}"))
    rows = placed.groupBy("feature").agg(*picks).collect()  # one row per feature
    out = {v: dict.fromkeys(columns) for v in values}
    for r in rows:
        for n, v in zip(names, values):
            lo, hi = r[f"lo_{n}"], r[f"hi_{n}"]
            out[v][r["feature"]] = None if lo is None else (lo + hi) / 2
    return out


def impute(df: DataFrame, fill: dict[str, float | None]) -> DataFrame:
    """Replace missing values; a column that was never known in training becomes 0."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0 if v is None else v)) for c, v in fill.items()})


def moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column (1 for a constant column)."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def standardise(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c).cast("double") - m) / s for c, (m, s) in stats.items()})


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (k * n_class) per class; one row per class."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    whole = counts.agg(F.sum("n_class").alias("n"), F.count(F.lit(1)).alias("k"))
    picked = whole.select((F.col("n") / F.col("k")).alias("share")).scalar()
    return counts.withColumn("weight", picked / F.col("n_class"))


def with_balanced_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Attach the class weight as a literal map; the classes are few by definition."""
    rows = balanced_weights(df, label).collect()
    return df.withColumn(name, fc.lookup(F.col(label).cast("int"), {int(r[label]): float(r["weight"]) for r in rows}))


def assemble(df: DataFrame, features: list[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=output, handleInvalid="error").transform(df)


def split_by_year(df: DataFrame, cut: int = fv.TRAIN_YEAR_MAX, year: str = "year") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(year) <= cut), df.filter(F.col(year) > cut)


def all_known(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def without_summary(model):
    """A classifier whose training summary is dropped, for scoring.

    The summary refers to the session, and the model travels to the executors with it. A session that has counted rows
    with an ``Observation`` cannot travel, so scoring would fail there.
    """
    if getattr(model, "hasSummary", False):
        model._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
    return model
