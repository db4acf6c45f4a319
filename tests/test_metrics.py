"""Metrics against brute force and against each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilframe.operators import metrics as mt
from perilframe.operators import scoring as sc
from perilframe.operators import splits as sp


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(600) < 0.3).astype(int)
    s = np.round(np.clip(rng.normal(0.35 + 0.2 * y, 0.2), 0, 1), 2)  # many ties, some exactly 0 and 1
    s[:3] = [0.0, 0.3, 1.0]
    return spark.createDataFrame([(int(i), int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))], "id long, y int, s double").cache()


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean())


@pytest.mark.parametrize("parts", [7, None])
def test_auc_three_ways(scored, parts):
    p = scored.toPandas()
    row = mt.rank_metrics(scored, [], "y", "s", parts=parts).first()
    assert row.auc_roc == pytest.approx(brute_auc(p.y.to_numpy(), p.s.to_numpy()), abs=1e-12)
    curve = mt.roc_curve(scored, [], "y", "s", parts=parts).toPandas().sort_values(["fpr", "tpr"])
    assert np.trapezoid(curve.tpr, curve.fpr) == pytest.approx(row.auc_roc, abs=1e-12)
    gain = curve.tpr - curve.fpr
    assert curve.threshold[gain.idxmax()] == pytest.approx(row.optimal_threshold)
    pr = mt.pr_curve(scored, [], "y", "s").toPandas().sort_values("threshold", ascending=False)
    known = pr[pr.threshold.notna()]
    steps = np.diff(np.concatenate([[0], known.recall]))
    assert (steps * known.precision).sum() == pytest.approx(row.avg_precision, abs=1e-12)


def test_single_class_and_subsets(spark, scored):
    assert mt.rank_metrics(scored.filter("y = 0"), [], "y", "s").first().auc_roc is None
    both = scored.withColumn("g", F.when(F.col("id") < 300, "a").when(F.col("y") == 0, "b").otherwise("a"))
    assert [r.g for r in mt.subset_performance(both, "g", "y", "s").collect()] == ["a"]


def test_probability_bins(spark):
    rows = [(0, 0.0), (1, 0.3), (1, 1.0), (0, 0.30000000000000004)]
    df = spark.createDataFrame(rows, "y int, s double")
    assert [(r.bin, r.n) for r in mt.calibration_curve(df, [], "y", "s").orderBy("bin").collect()] == [(1, 1), (2, 2), (3, 1)]
    ece = mt.expected_calibration_error(df, [], "y", "s").first()
    assert ece.ece == pytest.approx((0.0 + 0.7 + 0.3) / 4)  # the score of exactly 1 is in no bin
    assert mt.brier(df, [], "y", "s").first().brier_score == pytest.approx(ece.brier_score)


def test_report_and_f1(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.2), (0, 0.7), (0, 0.5), (0, 0.1)], "y int, s double")
    counts = mt.confusion(df, [], "y", "s", 0.5)
    assert tuple(counts.first()) == (1, 2, 1, 1)
    assert mt.f1(counts, []).first()[0] == pytest.approx(0.4)
    report = {r["class"]: r for r in mt.classification_report(counts).collect()}
    assert report["1"].precision == pytest.approx(1 / 3) and report["0"].recall == pytest.approx(1 / 3)
    assert report["accuracy"].f1 == pytest.approx(0.4) and report["macro avg"].support == 5


def test_ks_against_brute_force(spark):
    rng = np.random.default_rng(5)
    a, b = np.round(rng.normal(0, 1, 300), 1), np.round(rng.normal(0.4, 1, 200), 1)
    df = spark.createDataFrame([(1, float(v)) for v in a] + [(0, float(v)) for v in b], "t int, v double")
    got = mt.ks_two_sample(df, ["v"], F.col("t") == 1).first()
    grid = np.unique(np.concatenate([a, b]))
    want = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    assert got.ks_statistic == pytest.approx(want, abs=1e-12) and got.significant_shift
    assert got.train_std == pytest.approx(a.std()) and got.n_test == 200


def test_percent_rank_averages_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, 9.0), (5, None)], "id int, v double")
    got = {r.id: r.v_pct for r in sc.percent_rank(df, ["v"]).collect()}
    assert got == {3: 0.25, 1: 0.625, 2: 0.625, 4: 1.0, 5: None}


def test_folds_are_disjoint_and_even(spark, scored):
    folds = sp.kfold(scored, ["id"], 4, within=["y"]).toPandas()
    assert len(folds) == 600 and folds.id.is_unique
    sizes = folds.groupby(["y", "fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all()
    few = sp.kfold(scored.limit(2), ["id"], 4).toPandas()  # fewer rows than folds
    assert few.fold.is_unique


def test_expanding_windows(spark):
    series = spark.range(14).select(F.lit("s").alias("series"), F.expr("add_months(date'2020-01-01', cast(id as int))").alias("date"))
    got = sp.expanding(series, 3, keys=["series"]).groupBy("fold", "split").count().collect()
    assert {(r.fold, r.split): r["count"] for r in got} == {(0, "train"): 5, (0, "test"): 3, (1, "train"): 8, (1, "test"): 3, (2, "train"): 11, (2, "test"): 3}
