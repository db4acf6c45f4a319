"""Event declarations: cleaning and calendar aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import columns as fc
from ..functions import fixed_values as fv
from .dedup import first_per_key

ENTITY = ["county_fips", "fipsStateCode", "state"]


def clean_events(raw: DataFrame, start_year: int = fv.START_YEAR, end_year: int = fv.END_YEAR,
                 categories: dict[str, str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """Parse, key, categorise, restrict to the years and keep one row per (event, entity).

    ``order`` decides which of several programme rows is kept; the default is the declaration date
    followed by every other column, so that the choice never depends on task timing.
    """
    dates = [c for c in ("declarationDate", "incidentBeginDate", "incidentEndDate", "lastRefresh") if c in raw.columns]
    parsed = raw.withColumns({c: fc.timestamp(c) for c in dates})
    keyed = (parsed
             .withColumn("declaration_year", F.year("declarationDate"))
             .filter(F.col("declaration_year").between(start_year, end_year))
             .withColumns({
                 "fipsStateCode": fc.pad_code("fipsStateCode", 2, "00"),
                 "fipsCountyCode": fc.pad_code("fipsCountyCode", 3, "000"),
                 "county_fips": fc.compose_key("fipsStateCode", "fipsCountyCode"),
             }))
    default = [F.col("declarationDate")] + [F.col(c) for c in raw.columns if c != "declarationDate"]
    unique = first_per_key(keyed, ["disasterNumber", "county_fips"], order or default)
    # What follows from other columns is not shuffled with them.
    return unique.withColumns({
        "is_statewide": F.col("fipsCountyCode") == "000",
        "disaster_category": fc.lookup("incidentType", categories or fv.INCIDENT_CATEGORY, fv.DEFAULT_CATEGORY),
        "declaration_month": F.month("declarationDate"),
        "declaration_quarter": F.quarter("declarationDate"),
        "year_month": F.trunc("declarationDate", "month"),
        "incident_duration_days": fc.duration_days("incidentBeginDate", "incidentEndDate"),
    })


def _grouped(events: DataFrame, keys: dict[str, str]):
    """Group by renamed keys; rows with a missing key belong to no group."""
    named = events.select("*", *[F.col(c).alias(k) for k, c in keys.items() if k != c])
    return named.dropna(subset=list(keys)).groupBy(*keys)


def _counts() -> list[Column]:
    return [F.count("disasterNumber").alias("disaster_count"),
            F.count_distinct("disasterNumber").alias("unique_disasters")]


def _keys(entity: list[str], **renamed: str) -> dict[str, str]:
    return {**{e: e for e in entity}, **renamed, "disaster_category": "disaster_category"}


def entity_month(events: DataFrame) -> DataFrame:
    return _grouped(events, _keys(ENTITY, year="declaration_year", month="declaration_month")).agg(
        *_counts(), F.avg("incident_duration_days").alias("avg_duration_days"))


def entity_quarter(events: DataFrame) -> DataFrame:
    return _grouped(events, _keys(ENTITY, year="declaration_year", quarter="declaration_quarter")).agg(
        *_counts(), F.avg("incident_duration_days").alias("avg_duration_days"))


def state_month(events: DataFrame) -> DataFrame:
    return _grouped(events, _keys(ENTITY[1:], year="declaration_year", month="declaration_month")).agg(*_counts())


def national_month(events: DataFrame) -> DataFrame:
    return (_grouped(events, _keys([], year="declaration_year", month="declaration_month"))
            .agg(*_counts(), F.count_distinct("state").alias("states_affected"),
                 F.count_distinct("county_fips").alias("counties_affected"))
            .withColumn("date", fc.month_start("year", "month")))


def _types() -> Column:
    """Different categories. They are few, so a set holds them; a second distinct count would shuffle every row once for each."""
    return F.size(F.collect_set("disaster_category")).cast("long")


def entity_year(events: DataFrame) -> DataFrame:
    """Distinct events and types, mean and longest duration; statewide rows are left out."""
    return (events.filter(~F.col("is_statewide")).withColumnRenamed("declaration_year", "year")
            .dropna(subset=[*ENTITY, "year"]).groupBy(*ENTITY, "year")
            .agg(F.count_distinct("disasterNumber").alias("total_disasters"),
                 _types().alias("disaster_types"),
                 F.avg("incident_duration_days").alias("avg_incident_duration"),
                 F.max("incident_duration_days").alias("max_incident_duration")))


def count_column(category: str) -> str:
    return f"{category.lower().replace(' ', '_')}_count"


def category_counts(events: DataFrame, categories: list[str] = fv.CATEGORIES) -> DataFrame:
    """One count column per category of the fixed list; categories without events get 0."""
    wide = (events.filter(~F.col("is_statewide")).withColumnRenamed("declaration_year", "year")
            .dropna(subset=["county_fips", "year"])
            .groupBy("county_fips", "year").pivot("disaster_category", categories).count())
    return wide.toDF("county_fips", "year", *[count_column(c) for c in categories]).fillna(0)


def entity_year_with_types(events: DataFrame, categories: list[str] = fv.CATEGORIES) -> DataFrame:
    """The entity-year figures together with the category counts, from one pass over the events.

    Counts belong to (entity, year) even where several state labels share an entity code or an event has
    no state; the sum over that pair restores this. The events are dealt by entity once, which serves the distinct count,
    the sums, the panel joins and the windows of an entity; dealt by each of them, every event would be shuffled three times.
    """
    counts = {count_column(c): c for c in categories}
    both = (events.filter(~F.col("is_statewide")).withColumnRenamed("declaration_year", "year")
            .dropna(subset=["county_fips", "year"])
            .select(*ENTITY, "year", "disasterNumber", "disaster_category", "incident_duration_days")
            .repartition("county_fips").groupBy(*ENTITY, "year")
            .agg(F.count_distinct("disasterNumber").alias("total_disasters"),
                 _types().alias("disaster_types"),
                 F.avg("incident_duration_days").alias("avg_incident_duration"),
                 F.max("incident_duration_days").alias("max_incident_duration"),
                 *[F.count_if(F.col("disaster_category") == c).alias(n) for n, c in counts.items()]))
    pair = Window.partitionBy("county_fips", "year")
    return both.withColumns({n: F.sum(n).over(pair) for n in counts}).dropna(subset=ENTITY).select(
        "county_fips", "year", "fipsStateCode", "state", "total_disasters", "disaster_types",
        "avg_incident_duration", "max_incident_duration", *counts)


def annual_overview(events: DataFrame) -> DataFrame:
    return (events.dropna(subset=["declaration_year"]).groupBy("declaration_year")
            .agg(F.count("disasterNumber").alias("total_declarations"),
                 F.count_distinct("disasterNumber").alias("unique_events"),
                 F.count_distinct("county_fips").alias("counties_affected")))
