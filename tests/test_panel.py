"""Cleaning, joining and window features on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from perilframe.operators import events as ev
from perilframe.operators import insurance as ins
from perilframe.operators import panel as pn
from perilframe.operators import target as tg
from perilframe.operators.dedup import duplicate_keys, first_per_key

EVENT = ("disasterNumber int, state string, declarationDate string, incidentType string, incidentBeginDate string, "
         "incidentEndDate string, fipsStateCode string, fipsCountyCode string")


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        (1, "AL", "2005-03-01", "Fire", "2005-02-01", "2005-02-03", "1", "1"),
        (1, "AL", "2005-03-02", "Flood", "2005-02-01", "2005-02-03", "1", "1"),   # second programme, dropped
        (2, "AL", "2005-04-01", "Alien", "2005-02-01", None, "1", "1"),
        (3, "AL", "2009-01-01", "Snow", "2009-01-01", "2009-01-02", "1", "1"),
        (4, None, "2005-06-01", "Flood", "2005-06-01", "2005-06-02", "1", "3"),    # no state: in no group
        (5, "AL", "2005-06-01", "Flood", "2005-06-01", "2005-06-02", "1", None),   # statewide
        (6, "AL", "1999-06-01", "Flood", "1999-06-01", "1999-06-02", "1", "1"),    # before the range
        (7, "AL", "bad date", "Flood", None, None, "1", "1"),
    ]
    return ev.clean_events(spark.createDataFrame(rows, EVENT)).cache()


def test_cleaning(events):
    got = {(r.disasterNumber, r.county_fips): (r.disaster_category, r.is_statewide, r.incident_duration_days) for r in events.collect()}
    assert got == {(1, "01001"): ("Wildfire", False, 2.0), (2, "01001"): ("Other", False, None), (3, "01001"): ("Winter Storm", False, 1.0),
                   (4, "01003"): ("Flood", False, 1.0), (5, "01000"): ("Flood", True, 1.0)}


def test_null_keys_vanish_from_groups(events):
    assert ev.entity_month(events).filter(F.col("county_fips") == "01003").count() == 0
    assert ev.national_month(events).filter("month = 6").first().disaster_count == 2


def test_category_counts_cover_the_fixed_list(events):
    row = ev.entity_year_with_types(events).filter("year = 2005 and county_fips = '01001'").first()
    assert (row.total_disasters, row.disaster_types, row.wildfire_count, row.other_count, row.drought_count) == (2, 2, 1, 1, 0)
    pivoted = ev.category_counts(events).filter("year = 2005 and county_fips = '01001'").first()
    assert (pivoted.wildfire_count, pivoted.other_count, pivoted.drought_count) == (1, 1, 0)


def test_first_per_key_and_duplicates(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, v string")
    assert sorted(tuple(r) for r in first_per_key(df, ["k"], [F.col("o")]).collect()) == [("a", 1, "y"), ("b", 5, "z")]
    assert [r.k for r in duplicate_keys(df, ["k"]).collect()] == ["a"]


def test_windows_count_rows_not_years(spark):
    df = spark.createDataFrame([("a", 2004, 1), ("a", 2005, 2), ("a", 2009, 4), ("a", 2010, None), ("b", 2006, 7)], "county_fips string, year int, n int")
    got = {(r.county_fips, r.year): (r.roll, r.lag, r.yoy) for r in df.select(
        "county_fips", "year", pn.rolling_sum("n").alias("roll"), pn.lagged("n").alias("lag"), pn.yoy_change("n").alias("yoy")).collect()}
    assert got[("a", 2009)] == (7, 2, 1.0) and got[("a", 2010)] == (6, 4, None) and got[("b", 2006)] == (7, None, None)


def test_panel_joins(spark, events):
    spine = ev.entity_year_with_types(events)
    claims = spark.createDataFrame([("01001", 2005, 3, 10.0, 4.0, 3.0), ("99999", 2005, 1, 1.0, 1.0, 1.0)],
                                   "county_fips string, year int, claim_count long, total_claims_paid double, avg_claim_severity double, median_claim_severity double")
    help_ = spark.createDataFrame([("01001", 2005, 5.0, 6.0)], "county_fips string, year int, ha_total_damage double, ha_total_approved double")
    people = spark.createDataFrame([("01001", "x", 100.0, 9.0)], "county_fips string, NAME string, total_population double, median_home_value double")
    macro = spark.createDataFrame([(2005, 1.5)], "year int, FEDFUNDS double")
    panel = pn.build_panel(spine, claims, help_, people, macro, check_keys=True)
    rows = {r.year: r for r in panel.collect()}
    assert set(rows) == {2005, 2009} and panel.count() == 2
    assert rows[2009].claim_count == 0 and rows[2009].FEDFUNDS is None and rows[2005].ha_total_damage == 5.0
    features = {r.year: r for r in pn.engineer_features(panel).collect()}
    assert features[2005].fema_region == 4 and features[2005].premium_change_yoy is None and features[2005].claims_per_policy == 0.0
    assert features[2009].claim_count_lag1 == 3 and features[2005].damage_per_capita == 0.05
    with pytest.raises(ValueError):
        pn.build_panel(spine, claims.union(claims), help_, people, macro, check_keys=True)


def test_assistance_lands_on_the_first_entity(spark):
    events = spark.createDataFrame([(1, "AL", "01003", 2005), (1, "AL", "01001", 2005), (2, "AL", "01005", 2006)],
                                   "disasterNumber int, state string, county_fips string, declaration_year int")
    raw = spark.createDataFrame([(1, "AL", "10"), (1, "AL", "bad"), (2, "AL", "7"), (9, "AL", "5")], "disasterNumber int, state string, totalDamage string")
    full = raw.withColumns({c: F.lit("1") for c in ins.ASSISTANCE_AMOUNTS.values() if c != "totalDamage"})
    got = {(r.county_fips, r.year): r.ha_total_damage for r in ins.assistance_entity_year(full, events).collect()}
    assert got == {("01001", 2005): 10.0, ("01005", 2006): 7.0}


def test_composite_target_uses_training_years_only(spark):
    rows = [(f"c{i}", 2000 if i < 8 else 2010, float(i), i, 100.0 * i, 0.0 if i % 2 else None) for i in range(12)]
    panel = spark.createDataFrame(rows, "county_fips string, year int, avg_claim_severity double, cum_disasters_3yr int, total_claims_paid double, ha_total_damage double")
    limits = tg.threshold_row(panel, train_year_max=2005)
    assert (limits.severity_threshold, limits.disaster_threshold, limits.claims_paid_threshold) == (5.5, 5.25, 525.0)
    got = {r.county_fips: (r.risk_signal_count, r.uninsurability_risk) for r in tg.composite_target(panel, train_year_max=2005).collect()}
    assert got["c5"] == (0, 0) and got["c6"] == (3, 1) and got["c11"] == (3, 1)


def test_entity_years_shuffle_each_event_once(spark):
    rows = spark.createDataFrame([("01001", "01", "A", 2000, d, c, False, float(d)) for d, c in [(1, "Flood"), (1, "Fire"), (2, "Fire"), (3, None)]],
                                 "county_fips string, fipsStateCode string, state string, declaration_year int, disasterNumber long, disaster_category string, "
                                 "is_statewide boolean, incident_duration_days double")
    for made in (ev.entity_year(rows), ev.entity_year_with_types(rows)):
        # A second distinct count would make one copy of every row for each.
        assert "Expand" not in made._jdf.queryExecution().executedPlan().toString()
        row = made.first()
        assert (row["total_disasters"], row["disaster_types"], row["max_incident_duration"]) == (3, 2, 3.0)
        assert dict(made.dtypes)["disaster_types"] == "bigint"
