"""Registered model queries run at the full sizes of the functions behind them."""

import inspect
from types import SimpleNamespace

import pytest

from perilframe.models import classifiers as cl
from perilframe.plans import QUERIES
from perilframe.plans import bind_models as bm
from perilframe.studies import robustness as rb


class Stop(Exception):
    pass


def called_with(monkeypatch, owner, name, query):
    """What ``query`` hands to ``owner.name``, defaults filled in; the call itself is not run."""
    monkeypatch.undo()
    signature, seen = inspect.signature(getattr(owner, name)), []

    def record(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        seen.append(bound.arguments)
        raise Stop

    tables = SimpleNamespace(panel_features=lambda: None, once=lambda name, build: build(), stage=lambda name, build: build())
    monkeypatch.setattr(owner, name, record)
    monkeypatch.setattr(bm, "labelled", lambda t: None)
    monkeypatch.setattr(bm, "risk", lambda t: SimpleNamespace(train=None))
    monkeypatch.setattr(bm.Tables, "of", lambda *_: tables)
    with pytest.raises(Stop):
        QUERIES[query](None, "")
    return seen[0]


def sizes(estimator):
    trees = "maxIter" if estimator.hasParam("maxIter") else "numTrees"
    return estimator.getOrDefault(trees), estimator.getOrDefault("maxDepth")


def test_single_fits(monkeypatch, spark):
    assert sizes(called_with(monkeypatch, cl, "fit", "gbt_fit")["estimator"]) == (300, 5)
    assert sizes(called_with(monkeypatch, cl, "fit", "rf_fit")["estimator"]) == (500, 10)


def test_folds_and_grids(monkeypatch, spark):
    folds = called_with(monkeypatch, cl, "cross_validate", "cross_validate_clf")
    # The boosting comes first, then the forest.
    assert sizes(folds["estimator"]) == (300, 5) and sizes(cl.forest()) == (500, 10) and folds["k"] == 5
    assert called_with(monkeypatch, cl, "grid_search", "hyper_grid_search")["grid"] == {
        "maxIter": [200, 300, 500], "maxDepth": [3, 5, 7], "stepSize": [0.05, 0.1]}
    assert cl.FOREST_GRID == {"numTrees": [300, 500], "maxDepth": [8, 10, 15], "featureSubsetStrategy": ["sqrt", "log2"]}


@pytest.mark.parametrize("name,query", [
    ("feature_ablation", "feature_ablation"), ("geographic_cv", "geographic_cv"), ("temporal_stability", "temporal_stability"),
    ("prediction_stability", "prediction_stability"), ("threshold_fits", "sensitivity_thresholds_fits")])
def test_studies(monkeypatch, name, query):
    given = called_with(monkeypatch, rb, name, query)
    assert given["settings"] == cl.BOOSTING
    assert given.get("k", 5) == 5 and not given.get("grid")
    assert given.get("test_years", list(range(1996, 2002))) == list(range(1996, 2002))
