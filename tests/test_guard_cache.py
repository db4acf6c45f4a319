"""Joins that multiply rows are found; caches end with their scope; boxes are placed without a single task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilframe.operators import insurance as ins
from perilframe.operators import panel as pn
from perilframe.operators import summaries as sm
from perilframe.operators.guard import JoinGuard
from perilframe.series.forecast import partial_autocorrelations
from perilframe.sources.cache import cached


def sides(spark, states):
    spine = spark.createDataFrame([("01001", 2005, 2), ("01003", 2006, 1)], "county_fips string, year int, total_disasters int")
    claims = spark.createDataFrame([("01001", 2005, 3)], "county_fips string, year int, claim_count long")
    people = spark.createDataFrame([("01001", "x", 100.0)], "county_fips string, NAME string, total_population double")
    macro = spark.createDataFrame([(2005, 1.5), (2006, 2.5)], "year int, FEDFUNDS double")
    raw = spark.createDataFrame([("1001", s, 2005, "10.0", "1.0", "1.0", "1", "2005-01-01") for s in states],
                                "countyCode string, propertyState string, y int, totalInsurancePremiumOfThePolicy string, "
                                "totalBuildingInsuranceCoverage string, totalContentsInsuranceCoverage string, policyCount string, policyEffectiveDate string")
    return spine, claims, claims.select(*pn.KEY, F.lit(1.0).alias("ha_total_damage")), people, macro, ins.policies_entity_year(raw)


def test_policy_county_in_two_states_is_found(spark):
    for states, fine in ((["AL"], True), (["AL", "AL"], True), (["AL", "GA"], False)):
        guard = JoinGuard()
        panel = pn.build_panel(*sides(spark, states), guard=guard)
        assert panel.count() == (2 if fine else 3)
        if fine:
            guard.verify()
        else:
            with pytest.raises(ValueError, match="2 rows became 3"):
                guard.verify()


def test_guard_on_empty_sides_and_copies_that_match_nothing(spark):
    parts = sides(spark, ["AL"])
    guard = JoinGuard()
    assert pn.build_panel(parts[0].limit(0), *parts[1:], guard=guard).collect() == []
    guard.verify()
    guard, elsewhere = JoinGuard(), parts[1].withColumn("county_fips", F.lit("99999"))
    assert pn.build_panel(parts[0], elsewhere.union(elsewhere), *parts[2:], guard=guard).count() == 2
    guard.verify()


def test_cache_ends_with_its_scope(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    with cached(df) as held:
        assert held.count() == 100 and held.storageLevel.useMemory
    assert not df.storageLevel.useMemory
    with pytest.raises(ZeroDivisionError), cached(df):
        1 // 0
    assert not df.storageLevel.useMemory
    with cached(df), cached(df):
        pass
    df.persist()
    with cached(df):
        pass
    assert df.storageLevel.useMemory
    df.unpersist()


def test_boxes_are_placed_in_ranges(spark):
    df = spark.range(500).select((F.col("id") % 7).cast("string").alias("g"), ((F.col("id") * 37) % 101).cast("double").alias("x"))
    boxes = sm.box_stats(df, "g", "x")
    rows = boxes.collect()
    assert [r.g for r in sorted(rows, key=lambda r: r.place)] == [r.g for r in sorted(rows, key=lambda r: (-r["median"], r.g))]
    assert "Window [row_number" not in boxes._jdf.queryExecution().optimizedPlan().toString()


def durbin_levinson(acf):
    phi, out = np.zeros(0), [1.0]
    for k in range(1, len(acf)):
        last = (acf[k] - phi @ acf[k - 1:0:-1]) / (1.0 - phi @ acf[1:k])
        phi = np.append(phi - last * phi[::-1], last)
        out.append(float(last))
    return out


def test_partial_autocorrelations_against_numpy(spark):
    rng = np.random.default_rng(8)
    histories = []
    for n in (1, 2, 3, 12, 37):
        x = rng.normal(size=n + 5)
        x = x - x.mean()
        histories.append([float((x[k:] * x[:len(x) - k]).sum() / (x * x).sum()) for k in range(n)])
    df = spark.createDataFrame([(i, h) for i, h in enumerate(histories)], "i int, acf array<double>")
    for r in df.select("i", partial_autocorrelations(F.col("acf")).alias("p")).collect():
        assert np.allclose(r.p, durbin_levinson(np.array(histories[r.i])), atol=1e-9)
    flat = spark.createDataFrame([([1.0, None, None],), ([1.0, 1.0, 1.0],)], "acf array<double>")
    assert [r[0] for r in flat.select(partial_autocorrelations(F.col("acf"))).collect()] == [[1.0, None, None], [1.0, 1.0, 0.0]]
