"""Model fits, scoring and the studies around them.

Every query runs at the full sizes: tree numbers and depths, grids, folds, test years and cells of the surveyed studies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..models import attribution as at
from ..models import classifiers as cl
from ..models import features as ft
from ..models import glm
from ..models.together import together
from ..operators import metrics as mt
from ..operators import panel as pn
from ..operators import scoring as sc
from ..session import scratch_path
from ..studies import robustness as rb
from ..studies import sensitivity as se
from .bind_windows import labelled
from .registry import register, rnd
from .tables import CUT, END, START, Tables, with_views

#: Every year of the panel that has earlier ones to train on.
TEST_YEARS = list(range(START + 1, END + 1))


def _staged(t: Tables, name: str, build) -> glm.Prepared:
    """Prepared rows as a stage table, so that repeated fits read them instead of the panel joins."""
    def land():
        data = build()
        return glm.Prepared(t.stage(name, lambda: data.frame), data.features)
    return t.once(f"prepared:{name}", land)


def severity(t: Tables):
    return _staged(t, "severity_rows", lambda: glm.severity_data(t.panel_features(), CUT))


def severity_with_zeros(t: Tables):
    return _staged(t, "severity_zero_rows", lambda: glm.severity_data(t.panel_features(), CUT, with_zeros=True))


def surge(t: Tables):
    return _staged(t, "surge_rows", lambda: glm.surge_data(se.surge_base(t.panel_features()), 0.5, CUT))


def risk(t: Tables):
    return _staged(t, "risk_rows", lambda: cl.prepare(labelled(t), cut=CUT))


def gamma(t: Tables):
    return t.once("gamma", lambda: glm.fit_glm(severity(t).train, "gamma"))


def boosted(t: Tables):
    return t.once("boosted", lambda: cl.fit(cl.boosting(), risk(t).train))


def bagged(t: Tables):
    return t.once("bagged", lambda: cl.fit(cl.forest(), risk(t).train))


def both_classifiers(t: Tables):
    """The boosting and the forest, fitted at the same time: the many short jobs of the one leave cores to the other."""
    risk(t)
    return together([lambda: boosted(t), lambda: bagged(t)])


@register("glm_gamma", digits=6)
def _(t: Tables):
    data = severity(t)
    return glm.evaluate_glm(gamma(t), data.test, "Gamma GLM", data.train.count())


@register("glm_tweedie", digits=6)
def _(t: Tables):
    data = severity_with_zeros(t)
    return glm.evaluate_glm(glm.fit_glm(data.train, "tweedie", 1.5), data.test, "Tweedie (p=1.5)", data.train.count())


@register("glm_power_search", digits=6)
def _(t: Tables):
    return glm.tweedie_power_search(severity_with_zeros(t))[2]


@register("glm_logit_inference", digits=6)
def _(t: Tables):
    data = surge(t)
    return glm.coefficient_table(glm.fit_glm(data.train, "binomial"), data.features, "Logistic (Claims Surge)").withColumnRenamed("exp_coef", "odds_ratio")


#: SQL of every feature of the severity fits, in the units of the fit.
SEVERITY_SQL = {**{f'"{c}"': f'CAST("{c}" AS DOUBLE) / {fv.UNIT_DIVISORS.get(c, 1.0)}' for c in fv.SEVERITY_FEATURES},
           **{f'"fema_region_{r}"': f"CASE WHEN fema_region = {r} THEN 1.0 ELSE 0.0 END" for r in fv.REGIONS}}


@register("glm_gamma_score_equations", with_views(f"""SELECT feature, n_rows, {rnd('value', 4)} AS mean_fitted FROM (UNPIVOT
 (SELECT count(*) AS n_rows, CAST(1 AS DOUBLE) AS intercept, {', '.join(f'CASE WHEN max({c}) > min({c}) THEN avg({c}) END AS {c}' for c in SEVERITY_SQL)} FROM tr)
 ON COLUMNS(* EXCLUDE (n_rows)) INTO NAME feature VALUE value)""", "pf",
          extra=f"""tr AS (SELECT * FROM (SELECT {', '.join(f'{v} AS {c}' for c, v in SEVERITY_SQL.items())} FROM pf WHERE avg_claim_severity > 0 AND year <= {CUT})
 WHERE {' AND '.join(f'{c} IS NOT NULL' for c in SEVERITY_SQL)})"""), digits=4)
def _(t: Tables):
    """Mean of x * y / fitted for every feature x of the Gamma fit. Where the likelihood is greatest it equals the mean of x, which SQL computes."""
    data = severity(t)
    ratio = F.col("label") / F.col("prediction")
    means = gamma(t).transform(data.train).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(ratio).alias("intercept"),
                                               *[F.avg(F.col(c) * ratio).alias(c) for c in data.features])
    return means.unpivot(["n_rows"], ["intercept", *data.features], "feature", "mean_fitted")


@register("coef_table", digits=6)
def _(t: Tables):
    return glm.coefficient_table(gamma(t), severity(t).features, "Gamma GLM")


@register("logit_balanced", digits=6)
def _(t: Tables):
    data = surge(t)
    scored = glm.with_score(glm.fit_balanced_logit(data.train), data.test)
    return mt.rank_metrics(scored, [], "label", "score")


@register("cross_validate_glm", digits=6)
def _(t: Tables):
    folds = glm.cross_validate_gamma(severity(t), pn.KEY)
    return mt.mean_and_std(folds, ["rmse", "mae"])


def _scored(t: Tables, model):
    return glm.with_score(model, risk(t).test).select(*pn.KEY, "state", "fema_region", "label", "score")


@register("gbt_fit", digits=6)
def _(t: Tables):
    return cl.evaluate(_scored(t, boosted(t)).withColumn("model", F.lit("Gradient Boosting")), ["model"])


@register("rf_fit", digits=6)
def _(t: Tables):
    return cl.evaluate(_scored(t, bagged(t)).withColumn("model", F.lit("Random Forest")), ["model"])


@register("hyper_grid_search", digits=6)
def _(t: Tables):
    kinds = (("Gradient Boosting", cl.boosting(), cl.BOOSTING_GRID), ("Random Forest", cl.forest(), cl.FOREST_GRID))
    found = [cl.grid_search(risk(t).train, estimator, grid, pn.KEY, refit=False)[1].withColumn("model", F.lit(name))
             for name, estimator, grid in kinds]
    return found[0].unionByName(found[1])


def risk_folds(t: Tables):
    """Folds of both classifiers, told apart by ``model``."""
    kinds = (("Gradient Boosting", cl.boosting()), ("Random Forest", cl.forest()))
    train = risk(t).train
    return t.stage("risk_folds", lambda: reduce(lambda a, b: a.unionByName(b), together([
        lambda estimator=estimator, name=name: cl.cross_validate(train, estimator, pn.KEY, name=name) for name, estimator in kinds])))


@register("cross_validate_clf", digits=6)
def _(t: Tables):
    return mt.mean_and_std(risk_folds(t), rb.MEASURED, ("model",))


@register("feature_importance", digits=6)
def _(t: Tables):
    boosting, forest = both_classifiers(t)
    return cl.importance({"gb_importance": boosting, "rf_importance": forest}, risk(t).features)


def attributed(t: Tables):
    return t.stage("attributed", lambda: at.attribute(boosted(t), risk(t).test, pn.KEY))


@register("feature_attribution", digits=6)
def _(t: Tables):
    return at.mean_absolute(attributed(t), risk(t).features)


@register("attribution_sums", with_views(f"""SELECT year, count(*) AS n_rows, count(*) AS n_equal FROM pf WHERE year > {CUT} GROUP BY 1""", "pf"))
def _(t: Tables):
    """Rows of each test year, and those whose base and contributions add up to the model's raw score."""
    total = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda a, v: a + v)
    raw = boosted(t).transform(risk(t).test).select(*pn.KEY, vector_to_array("rawPrediction")[1].alias("raw"))
    return attributed(t).join(raw, pn.KEY).groupBy("year").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.abs(total - F.col("raw")) < 1e-6).alias("n_equal"))


@register("attribution_dependence", digits=6)
def _(t: Tables):
    return at.dependence(attributed(t), pn.KEY, risk(t).features, 4)


@register("model_save_load", digits=6)
def _(t: Tables):
    path = scratch_path(t.spark, "boosted-model")
    boosted(t).write().overwrite().save(path)
    return _scored(t, GBTClassificationModel.load(path)).select(*pn.KEY, "label", "score")


@register("score_entities", digits=6)
def _(t: Tables):
    scored = glm.with_score(boosted(t), risk(t).frame)
    return sc.score_entities(scored, ["county_fips", "state"], "score")


@register("feature_ablation", digits=6)
def _(t: Tables):
    return rb.feature_ablation(labelled(t), cut=CUT)


@register("geographic_cv", digits=6)
def _(t: Tables):
    return rb.geographic_cv(labelled(t), cut=CUT)


@register("temporal_stability", digits=6)
def _(t: Tables):
    return rb.temporal_stability(t.panel_features(), TEST_YEARS)


@register("prediction_stability", digits=6)
def _(t: Tables):
    return rb.prediction_stability(labelled(t), cut=CUT)


@register("sensitivity_thresholds_fits", digits=6)
def _(t: Tables):
    return rb.threshold_fits(t.panel_features(), cut=CUT)


@register("sensitivity_surge_fits", digits=6)
def _(t: Tables):
    return rb.surge_fits(t.panel_features(), cut=CUT)
