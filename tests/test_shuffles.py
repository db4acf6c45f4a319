"""What the panel stage shuffles and writes, and which fits run at the same time."""

import glob
import re
import threading
from datetime import date

import pytest
from pyspark.sql import functions as F

from perilframe.operators import events as ev
from perilframe.operators import insurance as ins
from perilframe.operators import panel as pn
from perilframe.plans import bind_models as bm
from perilframe.plans.tables import Tables
from perilframe.session import joins_by_part_of_key
from perilframe.sources.sinks import write_stage

COPART = "spark.sql.requireAllClusterKeysForCoPartition"


@pytest.fixture
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(name) for name in names]
    for name, value in zip(names, ("-1", "false")):
        spark.conf.set(name, value)
    yield
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def formatted(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def dealt_by(df):
    """The columns by which rows are dealt in each shuffle of the plan, in any order."""
    return [re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"hashpartitioning\(([^)]*), \d+\)", formatted(df))]


def clean(spark):
    rows = [("01001", "01", "A", 2000, "d1", "Flood", 1.0, False), ("01001", "01", "A", 2000, "d1", "Fire", 3.0, False),
            ("01001", "01", "B", 2000, "d2", "Flood", None, False), ("01001", "01", None, 2000, "d3", "Flood", 2.0, False),
            ("01001", "01", "A", 2001, "d4", None, 2.0, False), (None, "01", "A", 2001, "d5", "Fire", 2.0, False),
            ("01000", "01", "A", 2001, "d6", "Fire", 2.0, True), ("02002", "02", "C", None, "d7", "Fire", 2.0, False)]
    return spark.createDataFrame(rows, "county_fips string, fipsStateCode string, state string, declaration_year int, disasterNumber string, "
                                       "disaster_category string, incident_duration_days double, is_statewide boolean")


def test_events_of_entities_are_dealt_once(spark, no_broadcast):
    spine = ev.entity_year_with_types(clean(spark), ["Flood", "Fire"])
    assert dealt_by(spine) == ["county_fips"]
    got = {(r["county_fips"], r["year"], r["state"]): (r["total_disasters"], r["disaster_types"], r["flood_count"], r["fire_count"]) for r in spine.collect()}
    assert got == {("01001", 2000, "A"): (1, 2, 3, 1), ("01001", 2000, "B"): (1, 1, 3, 1), ("01001", 2001, "A"): (1, 0, 0, 0)}


def test_wide_panel_is_not_shuffled(spark, no_broadcast):
    spine = ev.entity_year_with_types(clean(spark))
    key = "county_fips string, year int, "
    claims = spark.createDataFrame([("01001", 2000, 4, 8.0, 2.0, 2.0, 0.5)],
                                   key + "claim_count long, total_claims_paid double, avg_claim_severity double, median_claim_severity double, avg_loss_ratio double")
    policies = spark.createDataFrame([("01001", 2000, 5.0), ("01001", 2001, 10.0)], "countyCode string, year int, avg_premium double")
    raw = spark.createDataFrame([("d1", "A", 7.0)], "disasterNumber string, state string, totalDamage double").withColumns(
        {c: F.lit(1.0) for c in ins.ASSISTANCE_AMOUNTS.values() if c != "totalDamage"})
    assistance = ins.assistance_entity_year(raw, clean(spark))
    people = spark.createDataFrame([("01001", "x", 100.0)], "county_fips string, NAME string, total_population double")
    macro = F.broadcast(spark.createDataFrame([(2000, 1.0)], "year int, FEDFUNDS double"))
    with joins_by_part_of_key(spark):
        wide = pn.engineer_features(pn.build_panel(spine, claims, assistance, people, macro, policies))
        dealt = dealt_by(wide)
        rows = sorted((r["year"], r["state"], r["claim_count"], r["ha_total_damage"], r["total_population"], r["claim_count_lag1"] is None) for r in wide.collect())
    assert dealt.count("county_fips") == 5 and not [keys for keys in dealt if "year" in keys]
    assert [r[:5] for r in rows] == [(2000, "A", 4, 7.0, 100.0), (2000, "B", 4, 7.0, 100.0), (2001, "A", 0, 0.0, 100.0)]
    assert [r[5] for r in rows].count(True) == 1


def test_join_setting_is_put_back(spark):
    before = spark.conf.get(COPART, None)
    with pytest.raises(ValueError):
        with joins_by_part_of_key(spark):
            assert spark.conf.get(COPART) == "false"
            raise ValueError
    assert spark.conf.get(COPART, None) == before


def test_lines_are_shuffled_without_text(spark, tmp_path, no_broadcast):
    tables = {
        "nation": ([(0, "N")], "n_nationkey int, n_name string"),
        "customer": ([(7, 0, "M")], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "part": ([(3, 10.0)], "p_partkey long, p_retailprice double"),
        "orders": ([(8, 7, "F", 1.0, date(1996, 1, 1))], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date"),
        "lineitem": ([(8, 3, 7, 2.0, 100.0, 0.1, 0.0, "R", "F", date(1996, 5, 1)), (8, 3, 1, 5.0, 100.0, 0.1, 0.5, "N", "F", date(1997, 5, 1)),
                      (8, 3, None, None, 100.0, 0.1, None, None, None, None)],
                     "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                     "l_returnflag string, l_linestatus string, l_shipdate date"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    t = Tables(spark, str(tmp_path))
    for df in (t.raw_claims(), t.raw_assistance()):
        shuffled = "".join(re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", formatted(df)))
        assert "l_extendedprice" in shuffled and not re.search("l_returnflag|l_linestatus|l_shipdate", shuffled)
    claims = [(r["yearOfLoss"], r["countyCode"], r["amountPaidOnBuildingClaim"] == "n/a", r["totalContentsInsuranceCoverage"], r["primaryResidenceIndicator"])
              for r in t.raw_claims().collect()]
    assert sorted(claims, key=str) == sorted([(1996, None, True, 500.0, "Y"), (1997, "01007", False, 500.0, "N"), (None, "01007", False, 0.0, "N")], key=str)
    helped = [(r["totalInspected"], r["totalDamage"] > 0, r["approvedForFemaAssistance"]) for r in t.raw_assistance().collect()]
    assert sorted(helped, key=str) == sorted([(2.0, True, 1.0), (5.0, False, 0.0), (None, False, 0.0)], key=str)


def test_claims_of_an_order_are_together_before_they_are_dealt_by_county(spark, tmp_path, no_broadcast):
    tables = {
        "nation": ([(0, "N")], "n_nationkey int, n_name string"),
        "customer": ([(7, 0, "M")], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "part": ([(3, 10.0), (4, 20.0)], "p_partkey long, p_retailprice double"),
        "orders": ([(8, 7, "F", 1.0, date(1996, 1, 1)), (9, None, "F", 1.0, date(1996, 1, 1))],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date"),
        # Lines without a known part, order or customer are no claims.
        "lineitem": ([(order, part, n, 2.0 + n, 100.0, 0.0, 0.0, "R", "O", date(1996, 5, n))
                      for n, (order, part) in enumerate([(8, 3), (8, 4), (8, 4), (9, 3), (8, 5), (None, 3), (8, None)], 1)],
                     "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                     "l_returnflag string, l_linestatus string, l_shipdate date"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    claims = Tables(spark, str(tmp_path)).raw_claims()
    lines = [keys for keys in dealt_by(claims) if keys.startswith("l_")]
    assert lines == ["l_partkey", "l_orderkey"]
    figures = ins.claims_entity_year(claims, 1995, 2001).select("county_fips", "year", "claim_count", "total_claims_paid", "avg_coverage").collect()
    assert [tuple(r)[:3] for r in figures] == [("01007", 1996, 3)]
    assert figures[0]["total_claims_paid"] == pytest.approx(3 * 73.291173)
    assert figures[0]["avg_coverage"] == pytest.approx((3 * 10.0 + 4 * 20.0 + 5 * 20.0) * 1.09371373 / 3 + 500)


def test_stage_tables_are_packed_and_read_back(spark, tmp_path):
    kept = write_stage(spark.range(5), f"{tmp_path}/a")
    assert glob.glob(f"{tmp_path}/a/*.zstd.parquet") and kept.count() == 5
    write_stage(spark.range(5), f"{tmp_path}/b", compression="gzip")
    assert glob.glob(f"{tmp_path}/b/*.gz.parquet")


class _Stages:
    def once(self, name, build):
        return build()

    stage = once


def test_both_classifiers_are_fitted_at_once(spark, monkeypatch):
    class Data:
        train = None

    met = threading.Barrier(2, timeout=20)  # breaks if one waits for the other to end
    monkeypatch.setattr(bm, "risk", lambda t: Data)
    monkeypatch.setattr(bm.cl, "fit", lambda estimator, train: met.wait() >= 0 and type(estimator).__name__)
    assert bm.both_classifiers(_Stages()) == ["GBTClassifier", "RandomForestClassifier"]

    def folds(data, estimator, keys, name):
        met.wait()
        return spark.createDataFrame([(name,)], "model string")

    monkeypatch.setattr(bm.cl, "cross_validate", folds)
    assert [r["model"] for r in bm.risk_folds(_Stages()).collect()] == ["Gradient Boosting", "Random Forest"]
