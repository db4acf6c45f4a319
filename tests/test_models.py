"""Fits recover known parameters; attributions add up; weights and medians match brute force."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from perilframe.models import attribution as at
from perilframe.models import classifiers as cl
from perilframe.models import features as ft
from perilframe.models import glm


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1500, 3))
    mean = np.exp(1.0 + 0.5 * x[:, 0] - 0.3 * x[:, 1])
    amount = rng.gamma(4.0, mean / 4.0)
    label = (rng.random(1500) < 1 / (1 + np.exp(-(1.5 * x[:, 0] + x[:, 2] * x[:, 1])))).astype(float)
    df = spark.createDataFrame([(i, *map(float, r), float(a), float(b)) for i, (r, a, b) in enumerate(zip(x, amount, label))],
                               "id int, a double, b double, c double, amount double, label double")
    return ft.assemble(df, ["a", "b", "c"]).cache()


def test_gamma_recovers_coefficients(spark, rows):
    model = glm.fit_glm(rows.select("features", F.col("amount").alias("label")), "gamma")
    table = {r.feature: r for r in glm.coefficient_table(model, ["a", "b", "c"], "m").collect()}
    assert table["a"].coefficient == pytest.approx(0.5, abs=0.05) and table["b"].coefficient == pytest.approx(-0.3, abs=0.05)
    assert table["a"].significant and not table["c"].significant
    for name, truth in (("intercept", 1.0), ("a", 0.5), ("b", -0.3), ("c", 0.0)):
        r = table[name]
        assert abs(r.coefficient - truth) < 4 * r.std_err
        assert np.log([r.ci_lower, r.exp_coef, r.ci_upper]) == pytest.approx([r.coefficient - 1.959964 * r.std_err, r.coefficient, r.coefficient + 1.959964 * r.std_err])
    # At the maximum of the likelihood the relative residuals are orthogonal to every feature.
    p = rows.toPandas()
    x = np.column_stack([np.ones(len(p)), p[["a", "b", "c"]]])
    mu = np.exp(x @ [table[n].coefficient for n in ("intercept", "a", "b", "c")])
    assert np.allclose(x.T @ ((p.amount - mu) / mu) / len(p), 0, atol=1e-6)
    assert table["intercept"].coefficient == pytest.approx(1.0, abs=0.05)


def test_power_search_prefers_the_lowest_criterion(spark, rows):
    data = glm.Prepared(rows.select("features", F.col("amount").alias("label"), F.lit("train").alias("split")), ["a", "b", "c"])
    model, power, table = glm.tweedie_power_search(data, (1.2, 1.8))
    assert power == 1.8 and table.filter("converged").count() == 2 and model is not None


@pytest.mark.parametrize("kind", ["boosting", "forest"])
def test_contributions_add_up_to_the_raw_score(spark, rows, kind):
    settings = cl.TreeSettings(trees=5, depth=3, min_leaf=5)
    model = cl.fit(cl.boosting(settings) if kind == "boosting" else cl.forest(settings), rows)
    found = at.attribute(model, rows, ["id"]).withColumn("total", F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda a, v: a + v))
    raw = "rawPrediction" if kind == "boosting" else "probability"
    want = model.transform(rows).select("id", vector_to_array(raw)[1].alias("raw"))
    gap = found.join(want, "id").agg(F.max(F.abs(F.col("total") - F.col("raw")))).first()[0]
    assert gap < 1e-9
    top = at.mean_absolute(found, ["a", "b", "c"]).orderBy(F.desc("mean_abs_shap")).first()
    assert top.feature == "a"
    pairs = at.dependence(found, ["id"], ["a", "b", "c"], 2)
    assert pairs.count() == 3000 and "a" in {r.feature for r in pairs.select("feature").distinct().collect()}


def walked(nodes, x):
    """Contributions of one row, one tree at a time."""
    out = np.zeros(len(x))
    for tree in {n.tree for n in nodes}:
        own = {n.id: n for n in nodes if n.tree == tree}
        node = own[0]
        while node.leftChild >= 0:
            child = own[node.leftChild if x[node.feature] <= node.threshold else node.rightChild]
            out[node.feature] += child.value - node.value
            node = child
    return out


@pytest.mark.parametrize("kind", ["boosting", "forest"])
def test_contributions_equal_a_walk_down_the_trees(spark, rows, kind):
    settings = cl.TreeSettings(trees=4, depth=4, min_leaf=5)
    model = cl.fit(cl.boosting(settings) if kind == "boosting" else cl.forest(settings), rows)
    few = rows.limit(60).unionByName(rows.filter("id = 3")).cache()
    nodes = at.tree_nodes(model, spark).drop("feature")
    path = at.scratch_path(spark, "again")
    model.write().overwrite().save(path)
    saved = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.id", "nodeData.split.featureIndex", F.get(
        "nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"))
    nodes = nodes.join(saved.withColumnRenamed("featureIndex", "feature"), ["tree", "id"]).collect()
    found = at.attribute(model, few, ["id"]).collect()
    assert sorted(r.id for r in found) == sorted(r.id for r in few.collect())
    for r in found:
        assert np.allclose(r.contributions, walked(nodes, r.x), atol=1e-12)


def test_contributions_of_trees_without_splits(spark, rows):
    flat = ft.assemble(rows.select("id", "label", F.lit(1.0).alias("a"), F.lit(2.0).alias("b")), ["a", "b"])
    model = cl.fit(cl.boosting(cl.TreeSettings(trees=2, depth=2, min_leaf=5)), flat)
    found = at.attribute(model, flat, ["id"])
    assert found.count() == 1500 and found.filter("contributions <> array(0D, 0D)").count() == 0
    assert at.attribute(model, flat.limit(0), ["id"]).collect() == []


def test_balanced_weights(spark, rows):
    w = ft.balanced_weights(rows, "label").collect()
    assert sum(r.weight * r.n_class for r in w) == pytest.approx(1500)
    assert len({round(r.weight * r.n_class, 9) for r in w}) == 1


def test_medians_outside_each_group(spark):
    rng = np.random.default_rng(2)
    pdf = [(int(g), None if v < -1 else float(v), float(np.round(v))) for g, v in zip(rng.integers(1, 4, 101), rng.normal(size=101))]
    df = spark.createDataFrame(pdf, "g int, x double, z double")
    frame = df.toPandas()
    got = ft.medians_without(df, ["x", "z"], "g", [1, 2, 3])
    for g in (1, 2, 3):
        for c in ("x", "z"):
            assert got[g][c] == pytest.approx(frame.loc[frame.g != g, c].median())
    assert ft.medians(df, ["x", "z"])["x"] == pytest.approx(frame.x.median())


def test_standardise_keeps_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    out = ft.standardise(df, ft.moments(df, ["a", "b"])).orderBy("a").collect()
    assert [tuple(r) for r in out] == [(-1.0, 0.0), (1.0, 0.0)]


def test_first_trees_are_the_shorter_fit(spark, rows):
    long = cl.fit(cl.boosting(cl.TreeSettings(trees=9, depth=3, min_leaf=5)), rows)
    short = cl.fit(cl.boosting(cl.TreeSettings(trees=4, depth=3, min_leaf=5)), rows)
    assert cl.first_trees(long, 4).toDebugString.split("\n", 1)[1] == short.toDebugString.split("\n", 1)[1]
    both = [model.transform(rows).select("id", vector_to_array("rawPrediction")[1]).orderBy("id").collect()
            for model in (cl.first_trees(long, 4), short)]
    assert both[0] == both[1] and cl.first_trees(long, 9).getNumTrees == 9


def test_grid_search_equals_fits_of_their_own(spark, rows):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    small = cl.TreeSettings(trees=3, depth=2, min_leaf=5)
    model, table = cl.grid_search(rows, cl.boosting(small), {"maxIter": [2, 5], "maxDepth": [1, 2]}, ["id"], k=2)
    found = {row.params: row for row in table.collect()}
    assert len(found) == 4 and sorted(row.rank_test_score for row in found.values()) == [1, 2, 3, 4]
    folded = cl.sized(cl.sp.kfold(ft.with_balanced_weight(rows, "label"), ["id"], 2, within=["label"])).cache()
    areas = [BinaryClassificationEvaluator(labelCol="label").evaluate(
        cl.boosting(cl.TreeSettings(trees=2, depth=1, min_leaf=5)).fit(folded.filter(F.col("fold") != fold)).transform(
            folded.filter(F.col("fold") == fold))) for fold in (1, 2)]
    assert found["maxDepth=1, maxIter=2"].mean_test_score == pytest.approx(np.mean(areas), abs=0.02)
    assert model.getNumTrees in (2, 5)


def test_medians_of_columns_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "x double, y double")
    assert ft.medians(df, ["x", "y"]) == {"x": 2.0, "y": None}
    assert [row.y for row in ft.impute(df, ft.medians(df, ["x", "y"])).collect()] == [0.0, 0.0]


def test_jobs_run_together_in_order(spark):
    from perilframe.models.together import sized, together

    assert together([lambda n=n: spark.range(n).count() for n in range(12)]) == list(range(12)) and together([]) == []
    with pytest.raises(ZeroDivisionError):
        together([lambda: 1, lambda: 1 // 0, lambda: 2])
    assert sized(spark.range(100).repartition(6), 40).rdd.getNumPartitions() == 3


def test_a_fit_has_no_more_tasks_than_cores(spark):
    from perilframe.models import together as tg

    cores = spark.sparkContext.defaultParallelism
    many = spark.range(4000).repartition(5 * cores)
    alone = tg.sized(many, 10)
    assert alone.rdd.getNumPartitions() == cores and alone.count() == 4000
    # They hold about the same number of rows, wherever these lay before.
    sizes = tg.sized(spark.range(4000).coalesce(1), 10).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == cores and max(sizes) - min(sizes) <= cores
    # Fits under way together share the cores.
    beside = tg.together([lambda: tg.sized(many, 10).rdd.getNumPartitions()] * 8)
    assert beside == [-(-2 * cores // 8)] * 8
    assert tg.sized(many, 4000).rdd.getNumPartitions() == 1


def test_forests_remember_nodes_where_memory_allows(rows, monkeypatch):
    data = ft.with_balanced_weight(rows, "label").select("label", "weight", "features").coalesce(1).cache()
    small = cl.forest(cl.TreeSettings(trees=12, depth=6, subsample=1.0))
    kept = cl.remembering(small, data)
    assert kept.getCacheNodeIds() and kept.getCheckpointInterval() == -1 and not small.getCacheNodeIds()
    assert kept.fit(data).toDebugString.split("\n")[1:] == small.fit(data).toDebugString.split("\n")[1:]
    assert cl.remembering(cl.boosting(), data).getCacheNodeIds() is False
    # Twelve trees of 1,500 rows take 144,000 bytes for two levels.
    monkeypatch.setattr(cl, "storage_memory", lambda spark: 2 * 144_000)
    assert cl.remembering(small, data).getCacheNodeIds()
    assert not cl.remembering(small, data, fits=2).getCacheNodeIds() and not cl.remembering(small, data, trees=13).getCacheNodeIds()
