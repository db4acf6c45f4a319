"""Claims, policies and assistance reduced to entity-years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import columns as fc
from ..functions import fixed_values as fv
from .dedup import first_per_key
from .refine import refined_stats

CLAIM_AMOUNTS = [
    "amountPaidOnBuildingClaim", "amountPaidOnContentsClaim", "amountPaidOnIncreasedCostOfComplianceClaim",
    "totalBuildingInsuranceCoverage", "totalContentsInsuranceCoverage",
    "buildingDamageAmount", "contentsDamageAmount",
]
ASSISTANCE_AMOUNTS = {
    "ha_total_inspected": "totalInspected",
    "ha_total_damage": "totalDamage",
    "ha_total_approved": "totalApprovedIhpAmount",
    "ha_repair_replace": "repairReplaceAmount",
    "ha_rental_amount": "rentalAmount",
    "ha_valid_registrations": "validRegistrations",
    "ha_approved_count": "approvedForFemaAssistance",
}


def claim_amounts(raw: DataFrame) -> DataFrame:
    """Readable amounts, paid / coverage / damage sums and the loss ratio of each claim."""
    present = [c for c in CLAIM_AMOUNTS if c in raw.columns]
    return (raw.withColumns({c: fc.number_or_zero(c) for c in present})
            .withColumns({
                "total_claim_paid": fc.total(*[c for c in CLAIM_AMOUNTS[:3] if c in present]),
                "total_coverage": fc.total(*CLAIM_AMOUNTS[3:5]),
                "total_damage": fc.total(*CLAIM_AMOUNTS[5:7]),
            })
            .withColumn("loss_ratio", fc.guarded_ratio("total_claim_paid", "total_coverage")))


def valid_claims(claims: DataFrame, start_year: int = fv.START_YEAR, end_year: int = fv.END_YEAR) -> DataFrame:
    """Claims of known counties in the year range."""
    return (claims.withColumn("county_fips", fc.pad_code("countyCode", 5, "00000"))
            .filter((F.col("county_fips") != "00000") & F.col("yearOfLoss").between(start_year, end_year)))


def claims_entity_year(raw: DataFrame, start_year: int = fv.START_YEAR, end_year: int = fv.END_YEAR) -> DataFrame:
    claims = valid_claims(claim_amounts(raw), start_year, end_year).withColumnRenamed("yearOfLoss", "year")
    keys = ["county_fips", "year"]
    stats = refined_stats(claims, keys, "total_claim_paid", {"median_claim_severity": 0.5}, {
        "damage": F.col("total_damage"), "ratio": F.col("loss_ratio"), "coverage": F.col("total_coverage"),
        "primary": fc.flag(F.col("primaryResidenceIndicator") == "Y")})
    rows = F.col("n_rows")
    return stats.select(
        *keys, rows.alias("claim_count"), F.col("total").alias("total_claims_paid"),
        (F.col("total") / F.col("n")).alias("avg_claim_severity"), "median_claim_severity",
        F.col("high").alias("max_claim_severity"), F.col("damage").alias("total_damage_reported"),
        (F.col("ratio") / rows).alias("avg_loss_ratio"), (F.col("coverage") / rows).alias("avg_coverage"),
        (F.col("primary") / rows).alias("pct_primary_residence"))


def policies_entity_year(raw: DataFrame) -> DataFrame:
    """Premium statistics, coverage sums and policy counts; a missing county code stays missing."""
    money = ["totalInsurancePremiumOfThePolicy", "totalBuildingInsuranceCoverage",
             "totalContentsInsuranceCoverage", "policyCount"]
    keys = ["countyCode", "propertyState", "year"]
    policies = (raw.withColumns({c: fc.number(c) for c in money})
                .withColumns({"countyCode": fc.pad_code("countyCode", 5),
                              "year": F.year(fc.timestamp("policyEffectiveDate"))})
                .dropna(subset=keys))
    stats = refined_stats(policies, keys, money[0], {"median_premium": 0.5}, {
        "building": F.col(money[1]), "contents": F.col(money[2]), "policies": F.col(money[3])})

    def or_zero(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0))

    return stats.select(
        *keys, F.try_divide("total", "n").alias("avg_premium"), "median_premium", or_zero("total").alias("total_premium"),
        or_zero("building").alias("total_building_coverage"), or_zero("contents").alias("total_contents_coverage"),
        or_zero("policies").alias("policy_count"), F.col("n_rows").alias("n_records"))


def event_entity_map(events: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """One entity and year for each (event, state): the first in ``order``."""
    slim = events.select("disasterNumber", "state", "county_fips", "declaration_year")
    return first_per_key(slim, ["disasterNumber", "state"],
                         order or [F.col("declaration_year"), F.col("county_fips")])


def assistance_by_event(raw: DataFrame, events: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Assistance summed per (event, state), joined to the entity that stands for that pair.

    Summing first leaves one row per pair on both sides, so a disaster with a third of all
    applications cannot overload the join.
    """
    amounts = raw.withColumns({c: fc.number_or_zero(c) for c in ASSISTANCE_AMOUNTS.values() if c in raw.columns})
    summed = (amounts.dropna(subset=["disasterNumber", "state"]).groupBy("disasterNumber", "state")
              .agg(*[F.sum(c).alias(n) for n, c in ASSISTANCE_AMOUNTS.items()],
                   F.count(F.lit(1)).alias("n_records")))
    return summed.join(event_entity_map(events, order), ["disasterNumber", "state"])


def assistance_entity_year(raw: DataFrame, events: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Assistance per entity and year. One row per event and state is left here, so rows are dealt by entity, as the panel needs them."""
    merged = assistance_by_event(raw, events, order).withColumnRenamed("declaration_year", "year")
    return (merged.dropna(subset=["county_fips", "year"]).repartition("county_fips").groupBy("county_fips", "year")
            .agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in ASSISTANCE_AMOUNTS]))
