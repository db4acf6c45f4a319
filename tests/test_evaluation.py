"""Prediction tables, folds and saved results of fitted classifiers, against NumPy and plain Python."""

import numpy as np
import pytest
from pyspark.sql import Observation, functions as F

from perilframe.models import classifiers as cl
from perilframe.models import evaluation as me
from perilframe.models import features as ft
from perilframe.models import glm
from perilframe.operators import metrics as mt
from perilframe.sources.results import load_result, save_results

SMALL = cl.TreeSettings(trees=4, depth=3, min_leaf=5)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 3))
    y = (rng.random(600) < 1 / (1 + np.exp(-(1.2 * x[:, 0] - 0.8 * x[:, 1] - 0.7)))).astype(float)
    made = spark.createDataFrame([(i, 1 + i % 3, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))],
                                 "id int, region int, a double, b double, c double, label double")
    return ft.assemble(made, ["a", "b", "c"]).cache()


@pytest.fixture(scope="module")
def table(spark, rows):
    # Scoring must work in a session that has counted rows before.
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 600
    models = {"p_rf": cl.fit(cl.forest(SMALL), rows), "p_gb": cl.fit(cl.boosting(SMALL), rows), "p_lr": glm.fit_balanced_logit(rows)}
    return me.prediction_table(models, rows, ["id", "region"]).cache()


NAMES = {"p_rf": "forest", "p_gb": "boosting", "p_lr": "logit"}


def test_every_row_has_every_probability(rows, table):
    assert table.columns == ["id", "region", "y_test", "p_rf", "p_gb", "p_lr"]
    found = table.toPandas()
    assert len(found) == 600 and found["id"].is_unique
    assert found[["p_rf", "p_gb", "p_lr"]].apply(lambda p: p.between(0, 1)).all(axis=None)
    long = me.by_model(table, NAMES, ["id"]).toPandas()
    assert len(long) == 1800 and set(long["model"]) == set(NAMES.values())
    assert long[long["model"] == "logit"].set_index("id")["score"].sort_index().equals(
        found.set_index("id")["p_lr"].sort_index().rename("score"))


def auc(y, s):
    positive, negative = s[y == 1], s[y == 0]
    return ((positive[:, None] > negative).sum() + 0.5 * (positive[:, None] == negative).sum()) / (len(positive) * len(negative))


def test_subsets_match_pairs(table):
    found = me.subsets(me.by_model(table, NAMES, ["region"]).withColumn("rare", F.when(F.rand(1) < 0, 1)), ["region", "rare"]).toPandas()
    assert len(found) == 9 and set(found["subset"]) == {"region"}  # an unknown value is no subset
    plain = table.toPandas()
    for r in found.itertuples():
        part = plain[plain["region"] == r.value]
        column = next(c for c, name in NAMES.items() if name == r.model)
        assert r.auc_roc == pytest.approx(auc(part["y_test"].to_numpy(), part[column].to_numpy()))
        assert r.n_samples == 200 and r.pos_rate == pytest.approx(part["y_test"].mean())
    assert me.subsets(me.by_model(table, NAMES, ["region"]), ["region"], min_positive=1000).isEmpty()


def test_confusion_is_taken_at_the_best_threshold(table):
    plain = table.toPandas()
    for r in me.at_youden(me.by_model(table, NAMES, [])).collect():
        column = next(c for c, name in NAMES.items() if name == r.model)
        y, s = plain["y_test"].to_numpy(), plain[column].to_numpy()
        gain = {v: (s[y == 1] >= v).mean() - (s[y == 0] >= v).mean() for v in np.unique(s)}
        assert gain[r.optimal_threshold] == pytest.approx(max(gain.values()))
        assert (r.tn, r.fp, r.fn, r.tp) == (((y == 0) & (s < r.optimal_threshold)).sum(), ((y == 0) & (s >= r.optimal_threshold)).sum(),
                                            ((y == 1) & (s < r.optimal_threshold)).sum(), ((y == 1) & (s >= r.optimal_threshold)).sum())


def test_folds_take_any_fit(rows, table):
    folds = cl.cross_validate(rows, glm.fit_balanced_logit, ["id"], name="logit").cache()
    assert folds.count() == 5 and folds.agg(F.sum("n_val")).first()[0] == 600
    spread = folds.agg(F.max("pos_rate") - F.min("pos_rate")).first()[0]
    assert spread < 0.02  # stratified
    line = me.comparison(me.by_model(table, {"p_lr": "logit"}, []), folds).first()
    values = [r.auc_roc for r in folds.collect()]
    assert line.cv_auc_mean == pytest.approx(np.mean(values)) and line.cv_auc_std == pytest.approx(np.std(values))
    assert {r.model: r.mean_auc_roc for r in mt.mean_and_std(folds, ["auc_roc"], ("model",)).collect()} == {"logit": pytest.approx(np.mean(values))}


def test_balanced_logit_is_at_its_optimum(rows):
    model = glm.fit_balanced_logit(rows)
    plain = rows.toPandas()
    x, y = plain[["a", "b", "c"]].to_numpy(), plain["label"].to_numpy()
    beta = np.array(model.coefficients)
    weight = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum()))
    p = 1 / (1 + np.exp(-(x @ beta + model.intercept)))
    assert np.allclose(x.T @ (weight * (y - p)), beta, atol=1e-3) and (weight * (y - p)).sum() == pytest.approx(0, abs=1e-3)


def test_results_are_read_back(spark, table, tmp_path):
    path = str(tmp_path / "run")
    manifest = save_results({"predictions": table, "none": table.limit(0)}, path)
    assert {(r.table, r.n_rows, r.n_columns) for r in manifest.collect()} == {("predictions", 600, 6), ("none", 0, 6)}
    assert load_result(spark, path, "predictions").exceptAll(table).isEmpty()
    assert load_result(spark, path, "none").columns == table.columns
    with pytest.raises(ValueError):
        load_result(spark, path, "absent")
    with pytest.raises(ValueError):
        save_results({"_tables": table}, path)
    text = str(tmp_path / "text")
    save_results({"predictions": table}, text, "csv")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields)
    assert load_result(spark, text, "predictions", "csv", schema).exceptAll(table).isEmpty()
