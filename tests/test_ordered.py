"""Any cut must agree with one range and brute force, hot keys and hot values included."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilframe.operators.ordered import exact_quantiles, grouped_stats, ordered_totals, positions


@pytest.fixture(scope="module")
def skewed(spark):
    # Key 0 holds most rows, and a third of its values are one constant.
    return spark.range(6000).select(
        F.when(F.col("id") < 4000, F.lit(0)).otherwise(F.col("id") % 7).alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(1500)) / 7.0).alias("v"),
        "id")


def test_cut_totals_match_one_range(spark, skewed):
    counted = skewed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
    plain = ordered_totals(counted, ["k"], "v", ["c"], parts=1)
    cut = ordered_totals(counted, ["k"], "v", ["c"], parts=9)
    assert sorted(plain.collect()) == sorted(cut.select(*plain.columns).collect())
    no_key = counted.groupBy("v").agg(F.sum("c").alias("c"))
    assert sorted(ordered_totals(no_key, [], "v", ["c"]).collect()) == sorted(
        ordered_totals(no_key, [], "v", ["c"], parts=9).collect())


@pytest.mark.parametrize("parts", [13, None])
def test_quantiles_match_numpy(spark, skewed, parts):
    got = {r["k"]: r for r in exact_quantiles(skewed, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.95},
                                              parts=parts).collect()}
    frame = skewed.toPandas()
    for k, g in frame.groupby("k"):
        want = np.quantile(g["v"], [0.1, 0.5, 0.95])
        assert np.allclose([got[k]["a"], got[k]["b"], got[k]["c"]], want)


def test_grouped_stats_keeps_null_values_apart(spark):
    df = spark.createDataFrame([(1, None, 1.0), (1, 4.0, 2.0), (1, 2.0, 3.0), (2, None, 5.0)], "k int, v double, x double")
    rows = {r["k"]: r for r in grouped_stats(df, ["k"], "v", {"med": 0.5}, {"xs": F.col("x")}).collect()}
    assert (rows[1]["n_rows"], rows[1]["n"], rows[1]["total"], rows[1]["med"], rows[1]["xs"]) == (3, 2, 6.0, 3.0, 6.0)
    assert (rows[2]["n_rows"], rows[2]["n"], rows[2]["total"], rows[2]["med"]) == (1, 0, None, None)


def test_positions_are_a_permutation(spark, skewed):
    placed = positions(skewed, ["k"], [-F.col("v"), F.col("id")], parts=11).toPandas()
    for _, g in placed.groupby("k"):
        ordered = g.sort_values(["v", "id"], ascending=[False, True])
        assert list(ordered["position"]) == list(range(1, len(g) + 1))


def test_one_plan_for_all_sizes(spark):
    def shape(rows):
        df = spark.range(rows).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("v"), F.lit(1).alias("c"))
        plan = ordered_totals(df, ["k"], "v", ["c"])._jdf.queryExecution().sparkPlan().toString()
        return re.sub(r"#\d+L?|file:\S+|\d+ paths?", "", plan)

    assert shape(30) == shape(300_000)


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, 5, 3), (1, 4, 7)], "k int, v int, c int")
    got = {(r["k"], r["v"]): (r["cum_c"], r["tot_c"]) for r in ordered_totals(df, ["k"], "v", ["c"], parts=3).collect()}
    assert got == {(None, 1): (2, 5), (None, 5): (5, 5), (1, 4): (7, 7)}
