"""How results move with the thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv
from ..operators import panel as pn
from ..operators import target as tg


def surge_base(panel: DataFrame) -> DataFrame:
    """Rows with a positive previous claim count, and the relative change since then."""
    w = pn.by_entity()
    return (panel.withColumns({"claim_count_prev": pn.lagged("claim_count", 1, w),
                               "claims_change_yoy": pn.yoy_change("claim_count", w)})
            .filter(F.col("claim_count_prev") > 0))


def target_rates(panel: DataFrame, quantiles=(0.5, 0.6, 0.75, 0.9), min_signals=(1, 2, 3, 4),
                 cut: int = fv.TRAIN_YEAR_MAX) -> DataFrame:
    """Positive rates of every (quantile, min_signals) label from a single pass over the panel.

    All threshold sets come from one ordered pass; each label is a conditional sum, so no row is
    copied per configuration.
    """
    limits = tg.thresholds(panel, {f"_{i}": tg.levels(q, q, q) for i, q in enumerate(quantiles)}, cut).first()
    counts = {f"_n{i}": sum(tg.signals({m: limits[f"{m}_{i}"] for m in tg.levels()}).values(), F.lit(0))
              for i in range(len(quantiles))}
    counted = panel.select("year", *[c.alias(n) for n, c in counts.items()])
    train = F.col("year") <= cut
    cells = {}
    for i, q in enumerate(quantiles):
        for m in min_signals:
            hit = F.when(F.col(f"_n{i}") >= m, 1).otherwise(0)
            cells[f"{q}|{m}"] = F.struct(
                F.avg(F.when(train, hit)).alias("pos_rate_train"), F.avg(F.when(~train, hit)).alias("pos_rate_test"),
                F.coalesce(F.sum(F.when(~train, hit)), F.lit(0)).alias("positives_test"),
                F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_test"))
    tall = counted.agg(*[c.alias(n) for n, c in cells.items()]).unpivot([], [f"`{n}`" for n in cells], "cell", "r")
    part = F.split("cell", r"\|")
    return tall.select(part[0].cast("double").alias("quantile"), part[1].cast("int").alias("min_signals"), "r.*")


def usable(rates: DataFrame, min_positive: int = 30, low: float = 0.01, high: float = 0.5) -> DataFrame:
    """Whether a configuration leaves enough, and not too many, positives to test a model."""
    ok = (F.col("positives_test") >= min_positive) & (F.col("pos_rate_test") >= low) & (F.col("pos_rate_test") <= high)
    return rates.withColumn("usable", F.coalesce(ok, F.lit(False)))


def surge_rates(panel: DataFrame, thresholds=(0.25, 0.5, 0.75, 1.0), cut: int = fv.TRAIN_YEAR_MAX) -> DataFrame:
    """Share of surges for several thresholds among the rows that know every feature, again from one pass."""
    train = F.col("year") <= cut
    base = surge_base(panel)
    base = base.dropna(subset=[c for c in fv.SURGE_STUDY_FEATURES if c in base.columns])
    cells = {}
    for t in thresholds:
        hit = pn.surge("claims_change_yoy", t)
        cells[str(t)] = F.struct(F.avg(F.when(train, hit)).alias("pos_rate"), F.avg(F.when(~train, hit)).alias("pos_rate_test"),
                                 F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_test"))
    tall = base.agg(*[c.alias(n) for n, c in cells.items()]).unpivot([], [f"`{n}`" for n in cells], "cell", "r")
    return tall.select(F.col("cell").cast("double").alias("surge_threshold"), "r.*")
