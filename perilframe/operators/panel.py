"""The entity-year panel and its features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import columns as fc
from ..functions import fixed_values as fv
from .dedup import duplicate_keys
from .guard import JoinGuard

KEY = ["county_fips", "year"]
ZERO_FILLED = ["claim_count", "total_claims_paid", "avg_claim_severity", "median_claim_severity",
               "ha_total_damage", "ha_total_approved"]
POLICY_COLUMNS = ["avg_premium", "median_premium", "total_premium", "total_building_coverage",
                  "total_contents_coverage", "policy_count", "n_records"]


def annual_means(macro: DataFrame, start_year: int = fv.START_YEAR, end_year: int = fv.END_YEAR,
                 date: str = "date") -> DataFrame:
    """Yearly mean of every numeric column."""
    series = [c for c in macro.columns if c != date]
    return (macro.withColumn("year", F.year(date)).filter(F.col("year").between(start_year, end_year))
            .groupBy("year").agg(*[F.avg(c).alias(c) for c in series]))


def align_series(series: list[DataFrame], date: str = "date") -> DataFrame:
    """Full outer join of several series on their date."""
    return reduce(lambda a, b: a.join(b, date, "full"), series)


def forward_fill(df: DataFrame, columns: list[str], order: str, keys: list[str]) -> DataFrame:
    """Carry the last known value forward within each series.

    A series is bounded by its calendar, so one partition per series key stays small.
    """
    seen = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(seen) for c in columns})


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def build_panel(events_year: DataFrame, claims: DataFrame, assistance: DataFrame, demographics: DataFrame,
                macro: DataFrame, policies: DataFrame | None = None, check_keys: bool = False,
                guard: JoinGuard | None = None) -> DataFrame:
    """Left-join every source onto the event spine and fill the claim columns with 0.

    All sides are keyed aggregates, so each join adds columns only. ``guard`` measures that while the panel is
    written, and its ``verify`` raises if a right side multiplied rows; ``check_keys`` asks before, by jobs of its own. No side is broadcast by hint: the optimizer does so
    only below its size limit, measured at run time.
    """
    if policies is not None:
        policies = policies.withColumnRenamed("countyCode", "county_fips").select(
            *KEY, *[c for c in POLICY_COLUMNS if c in policies.columns])
    sides = [(claims, KEY), (policies, KEY), (assistance, KEY),
             (demographics.drop("NAME"), ["county_fips"]), (macro, ["year"])]
    panel = events_year
    for side, keys in sides:
        if side is None:
            continue
        if check_keys and not duplicate_keys(side, keys).isEmpty():
            raise ValueError(f"keys {keys} are not unique")
        panel = guard.left_join(panel, side, keys) if guard else panel.join(side, keys, "left")
    return panel.fillna(0, [c for c in ZERO_FILLED if c in panel.columns])


def by_entity(order: str = "year", entity: str = "county_fips"):
    """The window all panel features share; identical specifications need one sort."""
    return Window.partitionBy(entity).orderBy(order)


def rolling_sum(column: str, rows: int = 3, window=None):
    """Sum over the last ``rows`` rows of an entity. Rows, not years: gaps are skipped over."""
    return F.sum(column).over((window or by_entity()).rowsBetween(1 - rows, 0))


def lagged(column: str, rows: int = 1, window=None):
    return F.lag(column, rows).over(window or by_entity())


def yoy_change(column: str, window=None):
    return fc.change_rate(column, lagged(column, 1, window))


def surge(change, threshold: float):
    return fc.flag(fc.as_col(change) > threshold)


def region_of(state_code):
    return fc.lookup(state_code, fv.STATE_REGION, 0)


LAGS = ["total_disasters", "claim_count", "avg_claim_severity", "avg_loss_ratio"]
LOGS = ["avg_claim_severity", "total_claims_paid", "ha_total_damage"]


def engineer_features(panel: DataFrame) -> DataFrame:
    have = panel.columns
    w = by_entity()
    wide = panel.withColumns({
        "fema_region": region_of("fipsStateCode"),
        "cum_disasters_3yr": rolling_sum("total_disasters", 3, w),
        "disaster_exposure_index": fc.weighted_index(have, fv.EXPOSURE_WEIGHTS),
        **{f"{c}_lag1": lagged(c, 1, w) for c in LAGS if c in have},
        **{f"log_{c}": F.log1p(c) for c in LOGS if c in have},
    })
    if "avg_premium" in have:
        wide = (wide.withColumn("premium_change_yoy", yoy_change("avg_premium", w))
                .withColumn("premium_surge_flag", surge("premium_change_yoy", 0.25)))
        if "policy_count" in have:
            wide = wide.withColumn("claims_per_policy", fc.guarded_ratio("claim_count", "policy_count"))
    else:
        wide = wide.withColumns({"premium_change_yoy": F.lit(None).cast("double"),
                                 "premium_surge_flag": F.lit(None).cast("int"),
                                 "claims_per_policy": F.lit(0.0)})
    if "total_population" in have and "median_home_value" in have:
        damage = "ha_total_damage" if "ha_total_damage" in have else F.lit(0.0)
        wide = wide.withColumns({"damage_per_capita": fc.guarded_ratio(damage, "total_population"),
                                 "claims_per_capita": fc.guarded_ratio("claim_count", "total_population")})
    return wide
