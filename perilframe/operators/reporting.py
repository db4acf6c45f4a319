"""Display tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .dedup import first_per_key
from .events import count_column

DASH = "—"


def counted_columns(df: DataFrame, keys: list[str]) -> DataFrame:
    """Pivot columns renamed to ``lower_case_count``."""
    return df.withColumnsRenamed({c: count_column(c) for c in df.columns if c not in keys})


def _fixed(c: str, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", F.col(c))


def _score(c: str) -> Column:
    return F.coalesce(F.when(F.col(c) > 10, F.format_number(c, 1)).otherwise(_fixed(c, 3)), F.lit(DASH))


def summary_table(metrics: DataFrame) -> DataFrame:
    """One formatted row per (module, model, metric); notes of the form name=value are laid out."""
    first = first_per_key(metrics, ["module", "model_name", "primary_metric"],
                          [F.col(c) for c in ("metric_value", "notes")])
    noted = first.withColumn("_value", F.try_element_at(F.split("notes", "="), F.lit(2)).try_cast("double"))
    layout = (F.when(F.col("notes").contains("AIC="), F.concat(F.lit("AIC = "), F.format_number("_value", 0)))
              .when(F.col("notes").contains("Brier="), F.concat(F.lit("Brier = "), _fixed("_value", 3)))
              .otherwise(F.coalesce(F.col("notes"), F.lit(DASH))))

    def or_dash(c: str) -> Column:
        return F.when(F.col(c).isNull(), DASH).otherwise(_fixed(c, 3))

    return noted.select(
        F.col("module").alias("Module"), F.col("model_name").alias("Model"), F.col("primary_metric").alias("Metric"),
        F.when(F.col("metric_value").isNull(), DASH).otherwise(_score("metric_value")).alias("Test Score"),
        or_dash("cv_metric").alias("CV Score"), or_dash("cv_std").alias("CV Std"), layout.alias("Notes"))


def transpose(df: DataFrame, label: str, metrics: list[str], labels: list[str]) -> DataFrame:
    """Metric rows with one column per label."""
    tall = df.unpivot([label], metrics, "metric", "value")
    return tall.groupBy("metric").pivot(label, labels).agg(F.first("value"))


def grid(df: DataFrame, row: str, column: str, columns: list, value: str) -> DataFrame:
    """Parameter grid as a matrix of mean values."""
    return df.groupBy(row).pivot(column, columns).agg(F.avg(value))


def best_row(df: DataFrame, metric: str, smallest: bool, prefer: str | None = None, tie: str | None = None) -> DataFrame:
    """The row with the best metric; rows whose ``prefer`` flag holds go before all others."""
    signed = F.col(metric) if smallest else -F.col(metric)
    keys = ([F.when(F.col(prefer), 0).otherwise(1)] if prefer else []) + [signed] + ([F.col(tie)] if tie else [])
    return df.filter(F.col(metric).isNotNull()).orderBy(*keys).limit(1)
