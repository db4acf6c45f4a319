"""Counts, distribution summaries and reporting tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import columns as fc
from ..functions import fixed_values as fv
from .ordered import exact_quantiles, grouped_stats, positions, with_quantiles


def group_sizes(df: DataFrame, keys: list[str], name: str = "count") -> DataFrame:
    """Rows per group; a missing key belongs to no group."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Frequencies in descending order, ties by value."""
    counts = group_sizes(df, [column]).orderBy(F.desc("count"), column)
    return counts if n is None else counts.limit(n)


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    return value_counts(df, column, n).select(column)


def keep_top(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows whose value is among the n most frequent ones."""
    return df.join(top_values(df, column, n), column, "left_semi")


def sizes_of_top(df: DataFrame, keys: list[str], column: str, n: int) -> DataFrame:
    """Group sizes restricted to the n most frequent values of ``column``.

    The base table is counted once; the top values are found in the counts.
    """
    sizes = group_sizes(df, keys)
    top = sizes.groupBy(column).agg(F.sum("count").alias("_n")).orderBy(F.desc("_n"), column).limit(n)
    return sizes.join(top, column, "left_semi").select(*keys, "count")


def trend(counts: DataFrame, series: str, x: str, y: str, overall: str = "all") -> DataFrame:
    """Least-squares slope and intercept over x, for each series and for their sum."""
    fit = [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")]
    each = counts.groupBy(F.col(series).alias("series")).agg(*fit)
    summed = counts.groupBy(x).agg(F.sum(y).alias(y)).agg(*fit).select(F.lit(overall).alias("series"), "slope", "intercept")
    return each.unionByName(summed)


def count_matrix(df: DataFrame, rows: list[str], column: str, values: list) -> DataFrame:
    """Cross table of counts over a fixed value list; empty cells are 0."""
    return df.groupBy(*rows).pivot(column, values).count().fillna(0)


def state_year_matrix(events: DataFrame, years: list[int]) -> DataFrame:
    """Distinct events by state and year, with row total and place by total."""
    distinct = (events.dropna(subset=["state", "declaration_year"]).groupBy("state", "declaration_year")
                .agg(F.count_distinct("disasterNumber").alias("n")))
    wide = distinct.groupBy("state").pivot("declaration_year", years).agg(F.first("n")).fillna(0)
    summed = wide.withColumn("total", reduce(lambda a, b: a + b, [F.col(f"`{y}`") for y in years]))
    # One row per state: the ranking window covers a fixed, small number of rows.
    return summed.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "state")))


def top_totals(events: DataFrame, keys: list[str], n: int) -> DataFrame:
    totals = (events.dropna(subset=keys).groupBy(*keys)
              .agg(F.count_distinct("disasterNumber").alias("total_disasters")))
    return totals.orderBy(F.desc("total_disasters"), keys[0], keys[-1]).limit(n)


def describe(df: DataFrame, keys: list[str], value: str, decimals: int | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of each group, from one pass."""
    x = F.col(value).cast("double")
    stats = grouped_stats(df, keys, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, {"squares": x * x})
    n, total = F.col("n"), F.col("total")
    spread = F.greatest(F.lit(0.0), F.col("squares") - total * total / n) / (n - 1)
    full = stats.select(*keys, n.alias("count"), F.try_divide(total, n).alias("mean"), F.when(n > 1, F.sqrt(spread)).alias("std"),
                        F.col("low").alias("min"), "q25", "q50", "q75", F.col("high").alias("max"))
    order = [*keys, "count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    if decimals is None:
        return full.select(*order)
    return full.select(*keys, "count", *[F.bround(c, decimals).alias(c) for c in order[len(keys) + 1:]])


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges, outlier count and place by median.

    The values are first counted per distinct value, so whiskers and outliers come from the counts.
    """
    counted = (df.filter(F.col(value).isNotNull()).dropna(subset=[group]).groupBy(group, F.col(value).alias("_x"))
               .agg(F.count(F.lit(1)).alias("_c")))
    quartiles = exact_quantiles(df.dropna(subset=[group]), [group], value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    low, high = F.col("q1") - reach, F.col("q3") + reach
    boxes = (counted.join(quartiles, group).groupBy(group, "q1", "median", "q3")
             .agg(F.min(F.when(F.col("_x") >= low, F.col("_x"))).alias("whisker_low"),
                  F.max(F.when(F.col("_x") <= high, F.col("_x"))).alias("whisker_high"),
                  F.coalesce(F.sum(F.when((F.col("_x") < low) | (F.col("_x") > high), F.col("_c"))), F.lit(0)).alias("outliers")))
    # Any column may be the group, so the boxes are put in order in ranges.
    return positions(boxes, [], [-F.col("median"), F.col(group)], "place")


def histogram(df: DataFrame, value: str, bins: int, low: float, high: float, by: list[str] | None = None) -> DataFrame:
    """Counts in ``bins`` equal intervals of [low, high]; the last one is closed."""
    width = (high - low) / bins
    x = F.col(value)
    slot = F.when(x >= high, bins - 1).otherwise(F.floor((x - low) * (bins / (high - low)))).cast("int")
    return (df.filter(x.between(low, high)).withColumn("bin", slot).groupBy(*(by or []), "bin")
            .agg(F.count(F.lit(1)).alias("n")).withColumn("bin_start", F.lit(low) + F.col("bin") * F.lit(width)))


def quantiles(df: DataFrame, value: str, which: dict[str, float]) -> DataFrame:
    return exact_quantiles(df, [], value, which)


def overview(events: DataFrame) -> DataFrame:
    """Headline figures of the event table."""
    days = F.col("incident_duration_days")
    return events.agg(
        F.count(F.lit(1)).alias("n_records"), F.min("declarationDate").cast("date").alias("first_date"),
        F.max("declarationDate").cast("date").alias("last_date"), F.count_distinct("disasterNumber").alias("n_events"),
        F.count_distinct("county_fips").alias("n_entities"), F.count_distinct("state").alias("n_states"),
        F.avg(days).alias("mean_duration"), F.stddev_samp(days).alias("std_duration"),
        F.min(days).alias("min_duration"), F.max(days).alias("max_duration"))


def top_with_context(ranked: DataFrame, panel: DataFrame, keys: list[str], score: str, n: int) -> DataFrame:
    """The n best entities with averages and totals from the panel.

    The panel is reduced to the chosen entities before it is aggregated.
    """
    top = ranked.orderBy(F.desc(score), keys[0]).limit(n)
    context = (panel.join(top.select(*keys), keys, "left_semi").groupBy(*keys)
               .agg(F.avg("avg_claim_severity").alias("mean_severity"), F.sum("total_disasters").alias("total_disasters"),
                    F.sum("claim_count").alias("total_claims"), F.avg("total_population").alias("population")))
    return top.join(context, keys, "left")


def entity_severity(panel: DataFrame) -> DataFrame:
    return (panel.filter(F.col("avg_claim_severity") > 0).groupBy("county_fips")
            .agg(F.avg("avg_claim_severity").alias("mean_severity"), F.sum("claim_count").alias("total_claims"),
                 F.count("avg_claim_severity").alias("years_with_claims")))


def severity_by_year(panel: DataFrame) -> DataFrame:
    hit = panel.filter(F.col("avg_claim_severity") > 0)
    yearly = hit.groupBy("year").agg(F.avg("avg_claim_severity").alias("mean_severity"), F.sum("claim_count").alias("total_claims"),
                                     F.count_distinct("county_fips").alias("counties_with_claims"))
    return with_quantiles(yearly, hit, ["year"], "avg_claim_severity", {"median_severity": 0.5})


def region_summary(df: DataFrame, score: str, region: str = "fema_region") -> DataFrame:
    """Mean, median and count of a score by region label, best region first; unlabelled rows are left out."""
    labelled = df.withColumn("label", fc.lookup(region, fv.REGION_LABEL)).dropna(subset=["label"])
    full = grouped_stats(labelled, ["label"], score, {"median": 0.5}).select(
        "label", F.try_divide("total", "n").alias("mean"), F.col("n").alias("count"), "median")
    return full.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), "label")))


def share_above(df: DataFrame, value: str, threshold: float) -> DataFrame:
    hit = F.when(F.col(value) > threshold, 1.0).otherwise(0.0)
    return df.agg(F.sum(hit).cast("long").alias("n_above"), F.avg(hit).alias("share_above"), F.count(value).alias("n"))


def flag_rates_by_year(labelled: DataFrame, flag: str, entity: str = "county_fips") -> DataFrame:
    return (labelled.groupBy("year").agg(F.avg(flag).alias("risk_rate"), F.sum(flag).alias("n_high_risk"),
                                         F.count_distinct(entity).alias("n_counties")))
