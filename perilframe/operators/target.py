"""The composite risk label: thresholds from training years, four signals, a minimum count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import columns as fc
from ..functions import fixed_values as fv
from .ordered import exact_quantiles

SEVERITY, DISASTERS, PAID, DAMAGE = "avg_claim_severity", "cum_disasters_3yr", "total_claims_paid", "ha_total_damage"
_MEASURES = {"severity_threshold": SEVERITY, "disaster_threshold": DISASTERS, "claims_paid_threshold": PAID}


def thresholds(panel: DataFrame, quantiles: dict[str, dict[str, float]], train_year_max: int = fv.TRAIN_YEAR_MAX) -> DataFrame:
    """One row of thresholds. ``quantiles`` maps a name suffix to the three quantile levels.

    Severity counts positive values only. The three measures are stacked and ordered in one pass.
    """
    train = panel.filter(F.col("year") <= train_year_max).select(
        F.when(F.col(SEVERITY) > 0, F.col(SEVERITY)).alias("severity_threshold"),
        F.col(DISASTERS).cast("double").alias("disaster_threshold"), F.col(PAID).alias("claims_paid_threshold"))
    tall = train.unpivot([], list(_MEASURES), "measure", "value")
    levels = sorted({q for level in quantiles.values() for q in level.values()})
    per_measure = exact_quantiles(tall, ["measure"], "value", {f"q{i}": q for i, q in enumerate(levels)})
    picks = [F.max(F.when(F.col("measure") == m, F.col(f"q{levels.index(level[m])}"))).alias(m + suffix)
             for suffix, level in quantiles.items() for m in _MEASURES]
    return per_measure.agg(*picks)


def levels(severity: float = 0.75, disasters: float = 0.75, paid: float = 0.75) -> dict[str, float]:
    return {"severity_threshold": severity, "disaster_threshold": disasters, "claims_paid_threshold": paid}


def threshold_row(panel: DataFrame, level: dict[str, float] | None = None, train_year_max: int = fv.TRAIN_YEAR_MAX):
    """The thresholds as plain numbers: a single row, whatever the size of the panel."""
    return thresholds(panel, {"": level or levels()}, train_year_max).first()


def signals(limits: dict[str, Column | float]) -> dict[str, Column]:
    """The four 0/1 signals; a missing measure or threshold gives 0."""
    def limit(name: str) -> Column:
        v = limits[name]
        return v if isinstance(v, Column) else F.lit(v).cast("double")

    return {
        "signal_high_severity": fc.flag(F.col(SEVERITY) >= limit("severity_threshold")),
        "signal_high_disasters": fc.flag(F.col(DISASTERS) >= limit("disaster_threshold")),
        "signal_ha_damage": fc.flag(F.col(DAMAGE) > 0),
        "signal_high_claims_paid": fc.flag(F.col(PAID) >= limit("claims_paid_threshold")),
    }


def composite_target(panel: DataFrame, severity_q: float = 0.75, disaster_q: float = 0.75, claims_q: float = 0.75,
                     min_signals: int = 2, train_year_max: int = fv.TRAIN_YEAR_MAX) -> DataFrame:
    """Signals, their count and the 0/1 label. The thresholds enter the plan as scalar subqueries."""
    limits = thresholds(panel, {"": levels(severity_q, disaster_q, claims_q)}, train_year_max)
    row = limits.select(F.struct(*_MEASURES)).scalar()
    flags = signals({m: row[m] for m in _MEASURES})
    counted = panel.withColumns(flags).withColumn("risk_signal_count", sum((F.col(s) for s in fv.SIGNALS), F.lit(0)))
    return counted.withColumn("uninsurability_risk", fc.flag(F.col("risk_signal_count") >= min_signals))


def signal_rates(labelled: DataFrame, cut: int = fv.TRAIN_YEAR_MAX, label: str = "uninsurability_risk") -> DataFrame:
    """Positive rate of each signal and of the label: overall, in training years and after them."""
    flags = [*fv.SIGNALS, label]
    train = F.col("year") <= cut
    rates = labelled.agg(*[F.struct(F.avg(f).alias("overall"), F.avg(F.when(train, F.col(f))).alias("train"),
                                    F.avg(F.when(~train, F.col(f))).alias("test")).alias(f) for f in flags])
    return rates.unpivot([], flags, "signal", "r").select("signal", "r.*")
