"""Quantiles by histogram refinement against NumPy: hot groups, hot values, ties, signs, nulls, extremes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilframe.operators.ordered import grouped_stats
from perilframe.operators.refine import binned_stats, counted_stats, log_bin, refined_stats

QUANTILES = {"a": 0.1, "b": 0.5, "c": 0.93}


def test_bins_never_fall(spark):
    rng = np.random.default_rng(5)
    values = sorted([float(v) for v in np.concatenate([rng.normal(size=400), np.exp(rng.normal(size=400) * 200), -np.exp(rng.normal(size=200) * 200)])]
                    + [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf")])
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").withColumn("bin", log_bin(F.col("v")))
    bins = [r.bin for r in rows.orderBy("i").collect()]
    assert bins == sorted(bins) and bins[0] < bins[1] and bins[-1] > bins[-2]
    odd = spark.createDataFrame([(float("nan"),), (None,)], "v double").select(log_bin(F.col("v"))).collect()
    assert odd[0][0] > bins[-1] and odd[1][0] is None


def test_quantiles_match_numpy(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") < 4000, F.lit(0)).when(F.col("id") < 6000, F.lit(1)).otherwise(F.col("id") % 900 + 2).alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7000.0 - 40).alias("v"))
    got = {r["k"]: r for r in refined_stats(df, ["k"], "v", QUANTILES, {"twice": F.col("v") * 2}).collect()}
    frame = df.toPandas()
    assert len(got) == frame["k"].nunique()
    for k, g in frame.groupby("k"):
        assert np.allclose([got[k][n] for n in QUANTILES], np.quantile(g["v"], list(QUANTILES.values())), rtol=0, atol=1e-9)
        assert (got[k]["n"], got[k]["low"], got[k]["high"]) == (len(g), g["v"].min(), g["v"].max())
        assert got[k]["total"] == pytest.approx(g["v"].sum()) and got[k]["twice"] == pytest.approx(2 * g["v"].sum())


def test_same_columns_and_rows_as_the_ordered_form(spark):
    df = spark.createDataFrame([(None, 3.0), (None, 1.0), (1, None), (1, 4.0), (1, 2.0), (2, None), (3, -7.5), (3, -7.5), (3, 0.0)], "k int, v double")
    one, other = (f(df, ["k"], "v", QUANTILES) for f in (refined_stats, grouped_stats))
    assert one.columns == other.columns
    assert sorted(one.collect(), key=str) == sorted(other.select(*one.columns).collect(), key=str)
    assert refined_stats(df.filter("k > 9"), ["k"], "v", QUANTILES).collect() == []
    assert refined_stats(df, [], "v", {"m": 0.5}).first()["m"] == pytest.approx(np.median([3, 1, 4, 2, -7.5, -7.5, 0]))


def test_small_groups_need_no_second_look(spark):
    df = spark.createDataFrame([(k, float(v)) for k in range(50) for v in (k, k * 3 + 1, k * 40 + 7)], "k int, v double")
    assert binned_stats(df, ["k"], "v", {"m": 0.5}, {}).filter("_at_lo_m is not null or _at_hi_m is not null").count() == 0


def test_small_groups_are_done_in_one_pass(spark):
    few = spark.createDataFrame([(None, 2.0), (None, 8.0), (1, None), (2, -1.5), (2, -1.5), (2, 0.0), (2, float("inf"))], "k int, v double")
    got = {r["k"]: r for r in counted_stats(few, ["k"], "v", {"m": 0.5}, {"s": F.lit(2)}).collect()}
    assert not any(r["_many"] for r in got.values())
    assert (got[None]["m"], got[None]["n"], got[None]["total"], got[None]["s"]) == (5.0, 2, 10.0, 4)
    assert (got[1]["m"], got[1]["n"], got[1]["n_rows"], got[1]["total"], got[1]["low"]) == (None, 0, 1, None, None)
    assert (got[2]["m"], got[2]["low"], got[2]["high"]) == (-0.75, -1.5, float("inf"))


def test_large_groups_and_nan_are_read_again(spark):
    df = spark.range(4000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 3 == 2, F.col("id") % 5).otherwise(F.pmod(F.xxhash64("id"), F.lit(9973))).cast("double").alias("v"))
    df = df.unionByName(spark.createDataFrame([(3, float("nan")), (3, 1.0), (3, 2.0)], "k long, v double")).coalesce(2)
    marked = {r["k"]: r["_many"] for r in counted_stats(df, ["k"], "v", QUANTILES, {}, few=16).collect()}
    assert marked == {0: True, 1: True, 2: False, 3: True}
    one, other = ({r["k"]: r for r in f.collect()} for f in (refined_stats(df, ["k"], "v", QUANTILES, few=16), grouped_stats(df, ["k"], "v", QUANTILES)))
    for k in (0, 1, 2):
        assert [one[k][c] for c in ("n", "low", "high", *QUANTILES)] == pytest.approx([other[k][c] for c in ("n", "low", "high", *QUANTILES)])
    assert one[3]["n"] == 3 and str(one[3]["high"]) == "nan" and one[3]["a"] == pytest.approx(1.2)
