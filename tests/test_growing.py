"""Trees that are grown in tasks of their own are those of Spark's fit, in far fewer jobs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilframe.models import classifiers as cl
from perilframe.models import draws
from perilframe.models import features as ft
from perilframe.models import treefits as tf


@pytest.fixture(scope="module")
def rows(spark):
    """Features with ties, zeros, two values and one value."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 9))
    x[:, 3], x[:, 4], x[:, 5], x[:, 6] = np.round(x[:, 3]), x[:, 4] > 0, 7.0, np.maximum(x[:, 6], 0)
    label = (rng.random(3000) < 1 / (1 + np.exp(-x[:, 0] - x[:, 1] * x[:, 4]))).astype(float)
    made = spark.createDataFrame([(*map(float, r), float(y)) for r, y in zip(x, label)], ", ".join(f"f{i} double" for i in range(9)) + ", label double")
    return ft.with_balanced_weight(ft.assemble(made, [f"f{i}" for i in range(9)]), "label").select("label", "weight", "features").cache()


def lines(model):
    """Splits and predictions of all trees, the latter to nine digits."""
    return [re.sub(r"Predict: (.*)", lambda found: f"Predict: {float(found[1]):.9g}", line) for line in model.toDebugString.split("\n")[1:]]


@pytest.mark.parametrize("settings", [cl.TreeSettings(trees=12, depth=5), cl.TreeSettings(trees=3, depth=7), cl.TreeSettings(trees=4, subset="all", subsample=1.0)])
def test_boosting_has_the_trees_of_sparks_fit(rows, settings):
    one, estimator = rows.coalesce(1).cache(), cl.boosting(settings)
    want, got = estimator.fit(one), tf.fit_boosting(estimator, one)
    assert lines(got) == lines(want) and got.treeWeights == want.treeWeights
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray())
    assert got.getMaxDepth() == settings.depth and got.numFeatures == 9


def test_rows_of_several_partitions_are_drawn_as_sparks_fit_draws_them(rows):
    many, estimator = rows.repartition(4).cache(), cl.boosting(cl.TreeSettings(trees=6, depth=4))
    want = lines(estimator.fit(many))
    assert lines(tf.fit_boosting(estimator, many)) == want
    # Beyond the number of rows that a task may hold, every partition has its own task.
    assert lines(tf.fit_boosting(estimator, many, alone=1000)) == want


def test_lost_predictions_are_made_again(rows, monkeypatch):
    many, estimator = rows.repartition(3).cache(), cl.boosting(cl.TreeSettings(trees=4, depth=3))
    grow, calls = tf.growing.grow, []

    def failing(*args):
        calls.append(len(calls))
        if len(calls) in (2, 3, 5):
            raise tf.Py4JJavaError("lost", type("Lost", (), {"_target_id": "o0", "_gateway_client": None})())
        return grow(*args)

    monkeypatch.setattr(tf.growing, "grow", failing)
    got = tf.fit_boosting(estimator, many, alone=1000)
    monkeypatch.undo()
    assert len(calls) == 7 and lines(got) == lines(estimator.fit(many))


def test_predictions_are_handed_on_and_not_made_again(rows, monkeypatch):
    """However many rounds there were, a job starts from the rows of the round before."""
    many, grow, lengths = rows.repartition(3).cache(), tf.growing.grow, []

    def looking(splits, depth, least, wanted, seed, sums):
        grown = grow(splits, depth, least, wanted, seed, sums)
        state = sums.__defaults__[0]
        lengths.append(state.toDebugString().count(b"PythonRDD"))
        return grown

    monkeypatch.setattr(tf.growing, "grow", looking)
    tf.fit_boosting(cl.boosting(cl.TreeSettings(trees=6, depth=2)), many, alone=1000)
    assert len(lengths) == 6 and len(set(lengths)) == 1


@pytest.mark.parametrize("settings", [cl.TreeSettings(trees=3, depth=3, subsample=1.0), cl.TreeSettings(trees=60, depth=8, subsample=1.0),
                                      cl.TreeSettings(trees=6, depth=6, subsample=0.7, subset="log2")])
def test_forest_has_the_trees_of_sparks_fit(rows, settings):
    one, estimator = rows.coalesce(1).cache(), cl.forest(settings)
    want, got = estimator.fit(one), tf.fit_forest(estimator, one)
    assert lines(got) == lines(want) and np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray())
    assert got.numClasses == 2 and got.getNumTrees == settings.trees


def test_forest_over_several_partitions_takes_the_rows_that_sparks_fit_takes(rows):
    many, estimator = rows.repartition(4).cache(), cl.forest(cl.TreeSettings(trees=10, depth=1, subsample=1.0))
    assert lines(tf.fit_forest(estimator, many)) == lines(estimator.fit(many))


def test_nodes_wait_where_memory_is_short(rows):
    one = rows.coalesce(1).cache()
    estimator = cl.forest(cl.TreeSettings(trees=40, depth=9, min_leaf=3, subsample=1.0)).setMaxMemoryInMB(1)
    assert lines(tf.fit_forest(estimator, one)) == lines(estimator.fit(one))


def test_large_forests_are_sparks(rows, monkeypatch):
    monkeypatch.setattr(tf, "_drawn", None)  # would fail if it were needed
    assert tf.fit_forest(cl.forest(cl.TreeSettings(trees=2, depth=2, subsample=1.0)), rows, most=2999).getNumTrees == 2


def test_a_boosting_needs_few_jobs(spark, rows):
    context = spark.sparkContext
    context.setJobGroup("few jobs", "")
    try:
        cl.fit(cl.boosting(cl.TreeSettings(trees=30, depth=5)), rows)
        assert len(context.statusTracker().getJobIdsForGroup("few jobs")) < 30
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_rows_that_cannot_be_fitted_are_refused_as_before(rows):
    for wrong in (rows.limit(0), rows.withColumn("label", F.lit(2.0)), rows.withColumn("weight", F.lit(-1.0))):
        with pytest.raises(Exception):
            cl.boosting(cl.TreeSettings(trees=2)).fit(wrong)
        with pytest.raises(Exception):
            tf.fit_boosting(cl.boosting(cl.TreeSettings(trees=2)), wrong)


def test_draws_are_sparks(spark):
    for seed, count in ((43, 200), (-7, 64), (2**40 + 1, 1)):
        want = [r[0] for r in spark.range(count, numPartitions=1).select(F.rand(seed)).collect()]
        assert draws.uniforms(seed, count).tolist() == want
    assert draws.uniforms(5, 0).size == 0
    java = spark._jvm.java.util.Random(42)
    seeds = draws.NodeSeeds(42)
    assert [seeds.next() for _ in range(5)] == [java.nextLong() for _ in range(5)]
    assert draws.chosen([1, 2], 4, 9).tolist() == [[0, 1, 2, 3]] * 2 and draws.chosen([], 4, 2).shape == (0, 2)
