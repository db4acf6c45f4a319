"""What is measured on the fitted models: prediction tables, folds, comparisons, saved results and score equations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv
from ..models import classifiers as cl
from ..models import evaluation as me
from ..models import features as ft
from ..models import glm
from ..operators import metrics as mt
from ..operators import panel as pn
from ..operators import target as tg
from ..series import forecast as fo
from ..session import scratch_path
from ..sources.results import MANIFEST, load_result, save_results
from ..studies import summary as su
from .bind_models import SEVERITY_SQL, both_classifiers, gamma, risk, risk_folds, severity, severity_with_zeros, surge
from .bind_series import folds_of_both
from .bind_windows import LABEL_CTE, SURGE_CTE
from .registry import register, rnd
from .tables import CUT, Tables, with_views

RISK_MODELS = {"y_prob_gb": "Gradient Boosting", "y_prob_rf": "Random Forest"}
SURGE_MODELS = {"y_prob": "Logistic Regression"}
_PLACE = [*pn.KEY, "fema_region"]


# ---- fitted models and their predictions ----------------------------------------------------------
def tweedie(t: Tables):
    return t.once("tweedie", lambda: glm.fit_glm(severity_with_zeros(t).train, "tweedie", 1.5))


def balanced(t: Tables):
    return t.once("balanced", lambda: glm.fit_balanced_logit(surge(t).train))


def risk_table(t: Tables) -> DataFrame:
    return t.stage("risk_predictions", lambda: me.prediction_table(
        dict(zip(RISK_MODELS, both_classifiers(t))), risk(t).test, [*pn.KEY, "state", "fema_region"]))


def risk_long(t: Tables) -> DataFrame:
    return me.by_model(risk_table(t), RISK_MODELS, _PLACE)


def surge_table(t: Tables) -> DataFrame:
    return t.stage("surge_predictions", lambda: me.prediction_table({"y_prob": balanced(t)}, surge(t).test, pn.KEY))


def surge_long(t: Tables) -> DataFrame:
    return me.by_model(surge_table(t), SURGE_MODELS, pn.KEY)


def surge_folds(t: Tables) -> DataFrame:
    return t.stage("surge_folds", lambda: cl.cross_validate(surge(t).train, glm.fit_balanced_logit, pn.KEY, name="Logistic Regression"))


# ---- both risk classifiers ------------------------------------------------------------------------
@register("risk_predictions", digits=6)
def _(t: Tables):
    return risk_table(t)


@register("risk_prediction_counts", with_views(f"""SELECT model, year, count(*) AS n_rows, CAST(sum(uninsurability_risk) AS BIGINT) AS n_positive, count(*) AS n_scored
 FROM lb JOIN (SELECT unnest({list(RISK_MODELS.values())}) AS model) ON true WHERE year > {CUT} GROUP BY 1, 2""", "pf", extra=LABEL_CTE))
def _(t: Tables):
    """Rows, positives and rows with a probability between 0 and 1, of each model and test year."""
    return risk_long(t).groupBy("model", "year").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("n_positive"), F.count_if(F.col("score").between(0, 1)).alias("n_scored"))


@register("risk_calibration", digits=6)
def _(t: Tables):
    return mt.calibration_curve(risk_long(t), ["model"], "label", "score")


@register("risk_calibration_error", digits=6)
def _(t: Tables):
    return mt.expected_calibration_error(risk_long(t), ["model"], "label", "score")


@register("risk_calibration_totals", with_views(f"""SELECT model, count(*) AS n, CAST(sum(uninsurability_risk) AS BIGINT) AS n_positive
 FROM lb JOIN (SELECT unnest({list(RISK_MODELS.values())}) AS model) ON true WHERE year > {CUT} GROUP BY 1""", "pf", extra=LABEL_CTE))
def _(t: Tables):
    """Rows and positives that the calibration bins of each model hold together: every test row is in one bin."""
    bins = mt.calibration_curve(risk_long(t), ["model"], "label", "score")
    return bins.groupBy("model").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("fraction_positive"))).cast("long").alias("n_positive"))


@register("risk_subset_performance", digits=6)
def _(t: Tables):
    return me.subsets(risk_long(t), ["fema_region", "year"])


@register("risk_subset_sizes", with_views(" UNION ALL ".join(f"""SELECT model, '{key}' AS subset, CAST({key} AS BIGINT) AS value, count(*) AS n_samples, {rnd('avg(uninsurability_risk)', 6)} AS pos_rate
 FROM lb JOIN (SELECT unnest({list(RISK_MODELS.values())}) AS model) ON true WHERE year > {CUT} GROUP BY 1, 3
 HAVING sum(uninsurability_risk) >= 5 AND sum(uninsurability_risk) < count(*)""" for key in ("fema_region", "year")), "pf", extra=LABEL_CTE), digits=6)
def _(t: Tables):
    """Which regions and test years are measured, their sizes and positive rates."""
    return me.subsets(risk_long(t), ["fema_region", "year"]).drop("auc_roc")


@register("risk_roc_curves", digits=6)
def _(t: Tables):
    return mt.roc_curve(risk_long(t), ["model"], "label", "score")


@register("risk_cv_folds", digits=6)
def _(t: Tables):
    return risk_folds(t)


@register("risk_comparison", digits=6)
def _(t: Tables):
    return me.comparison(risk_long(t), risk_folds(t))


# ---- surge classifier -----------------------------------------------------------------------------
@register("surge_predictions", digits=6)
def _(t: Tables):
    return surge_table(t)


@register("surge_cv_folds", digits=6)
def _(t: Tables):
    return surge_folds(t)


@register("surge_comparison", digits=6)
def _(t: Tables):
    return me.comparison(surge_long(t), surge_folds(t))


@register("surge_confusion", digits=6)
def _(t: Tables):
    return me.at_youden(surge_long(t))


@register("surge_report", digits=6)
def _(t: Tables):
    return mt.classification_report(me.at_youden(surge_long(t)), ("No Surge", "Surge"))


#: SQL of every feature of the surge fit, and the training rows that know all of them.
_SURGE_SQL = {**{f'"{c}"': f'CAST("{c}" AS DOUBLE)' for c in fv.SURGE_FEATURES},
              **{f'"fema_region_{r}"': f"CASE WHEN fema_region = {r} THEN 1.0 ELSE 0.0 END" for r in fv.REGIONS}}


def _surge_rows(name: str, test: str) -> str:
    return (f"{name} AS (SELECT * FROM (SELECT year, surge, {', '.join(f'{v} AS {c}' for c, v in _SURGE_SQL.items())} FROM sg WHERE year {test})"
            f" WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _SURGE_SQL)})")


@register("surge_class_counts", with_views("SELECT count(*) FILTER (surge = 0) AS actual_0, count(*) FILTER (surge = 1) AS actual_1 FROM te", "pf",
                                           extra=f"{SURGE_CTE}, {_surge_rows('te', f'> {CUT}')}"))
def _(t: Tables):
    """The rows of the confusion table, summed over what was predicted."""
    return me.at_youden(surge_long(t)).select((F.col("tn") + F.col("fp")).alias("actual_0"), (F.col("fn") + F.col("tp")).alias("actual_1"))


# ---- score equations: what a fit at its optimum must reproduce, and SQL can compute without it -------
def _tall(columns: dict[str, str], rows: str, mean: str, intercept: str) -> str:
    """SQL: one row per feature that varies in ``rows``, and one for the intercept; ``mean`` is its expression of {x}."""
    each = ", ".join(f"CASE WHEN max({c}) > min({c}) THEN {mean.format(x=c)} END AS {c}" for c in columns)
    return f"""SELECT feature, n_rows, {rnd('value', 4)} AS mean_fitted FROM (UNPIVOT
 (SELECT count(*) AS n_rows, CAST({intercept} AS DOUBLE) AS intercept, {each} FROM {rows}) ON COLUMNS(* EXCLUDE (n_rows)) INTO NAME feature VALUE value)"""


def _means(scored: DataFrame, features: list[str], weight, extra: dict[str, float] | None = None) -> DataFrame:
    """Mean of ``weight`` times every feature (1 for the intercept), plus ``extra`` of the feature."""
    means = scored.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(weight).alias("intercept"),
                       *[(F.avg(F.col(c) * weight) + F.lit((extra or {}).get(c, 0.0))).alias(c) for c in features])
    return means.unpivot(["n_rows"], ["intercept", *features], "feature", "mean_fitted")


@register("glm_logit_score_equations", with_views(
    _tall(_SURGE_SQL, "tr", "(avg({x} * surge) - avg({x}) * avg(surge)) / stddev_pop({x})", "avg(surge)"), "pf",
    extra=f"{SURGE_CTE}, {_surge_rows('tr', f'<= {CUT}')}"), digits=4)
def _(t: Tables):
    """Mean of x * probability over the training rows, for every standardised x. At the optimum it is the mean of x * y."""
    data = surge(t)
    model = t.once("logit", lambda: glm.fit_glm(data.train, "binomial"))
    return _means(model.transform(data.train), data.features, F.col("prediction"))


@register("logit_balanced_score_equations", with_views(
    _tall(_SURGE_SQL, "tr", "(avg({x}) FILTER (surge = 1) - avg({x})) / stddev_pop({x}) / 2", "0.5"), "pf",
    extra=f"{SURGE_CTE}, {_surge_rows('tr', f'<= {CUT}')}"), digits=4)
def _(t: Tables):
    """Weighted mean of x * probability plus the pull of the penalty. At the optimum it is half the mean of x among the surges."""
    data, model = surge(t), balanced(t)
    scored = glm.with_score(model, ft.with_balanced_weight(data.train, "label"))
    n = data.train.count()
    pull = {c: float(b) / n for c, b in zip(data.features, model.coefficients)}
    return _means(scored, data.features, F.col("weight") * F.col("score"), pull)


@register("glm_tweedie_score_equations", with_views(_tall(SEVERITY_SQL, "tr", "avg({x})", "1"), "pf",
          extra=f"""tr AS (SELECT * FROM (SELECT {', '.join(f'{v} AS {c}' for c, v in SEVERITY_SQL.items())} FROM pf WHERE year <= {CUT})
 WHERE {' AND '.join(f'{c} IS NOT NULL' for c in SEVERITY_SQL)})"""), digits=4)
def _(t: Tables):
    """Mean of x plus the mean of x times the weighted residual, relative to the mean fitted variance. The second is 0 at the optimum."""
    data, model = severity_with_zeros(t), tweedie(t)
    scored = model.transform(data.train)
    mu = F.col("prediction")
    size = scored.agg(F.avg(F.sqrt(mu))).first()[0]  # one number
    return _means(scored, data.features, 1 + (F.col("label") - mu) / F.sqrt(mu) / size)


# ---- comparisons over modules, saved tables -------------------------------------------------------
def glm_table(t: Tables) -> DataFrame:
    return t.stage("glm_comparison", lambda: glm.evaluate_glm(gamma(t), severity(t).test, "Gamma GLM", severity(t).train.count()).unionByName(
        glm.evaluate_glm(tweedie(t), severity_with_zeros(t).test, "Tweedie (p=1.5)", severity_with_zeros(t).train.count())))


@register("glm_comparison", digits=6)
def _(t: Tables):
    """Gamma and Tweedie fits side by side, on their own test rows."""
    return glm_table(t)


@register("forecast_comparison", digits=6)
def _(t: Tables):
    """Mean fold errors of both forecast models, one column each."""
    return fo.compare(folds_of_both(t), ["sarima", "trend"])


@register("model_summary", digits=6)
def _(t: Tables):
    """Every fitted module in one table: forecasts, severity, surge and risk."""
    series = folds_of_both(t).groupBy("model").agg(F.avg("rmse").alias("rmse"), F.lit("Time series forecasting").alias("notes"))
    surges = me.comparison(surge_long(t), surge_folds(t)).withColumn("notes", F.lit("Claims surge prediction"))
    return su.cross_module({"series": (1, series), "glm": (2, glm_table(t)), "surge": (2, surges),
                            "risk": (3, me.comparison(risk_long(t), risk_folds(t)))})


def _names(t: Tables, features: list[str]) -> DataFrame:
    return t.spark.createDataFrame([(i, f) for i, f in enumerate(features)], "position int, feature string")


def saved(t: Tables) -> str:
    """The folder with all tables of the severity, surge and label modules."""
    def save() -> str:
        path = scratch_path(t.spark, "results")
        logit = t.once("logit", lambda: glm.fit_glm(surge(t).train, "binomial"))
        dispersion = {"gamma": float(gamma(t).summary.dispersion), "tweedie": float(tweedie(t).summary.dispersion)}
        save_results({
            "target_thresholds": tg.thresholds(t.panel_features(), {"": tg.levels()}, CUT),
            "gamma_coefficients": glm.coefficient_table(gamma(t), severity(t).features, "Gamma GLM"),
            "tweedie_coefficients": glm.coefficient_table(tweedie(t), severity_with_zeros(t).features, "Tweedie (p=1.5)"),
            "surge_coefficients": glm.coefficient_table(logit, surge(t).features, "Logistic (Claims Surge)"),
            "glm_comparison": glm_table(t),
            "gamma_diagnostics": mt.residuals(glm.predict_severity(gamma(t), severity(t).test).select(*pn.KEY, "label", "predicted"),
                                              "label", "predicted", dispersion["gamma"]),
            "tweedie_diagnostics": mt.residuals(glm.predict_severity(tweedie(t), severity_with_zeros(t).test).select(*pn.KEY, "label", "predicted"),
                                                "label", "predicted", dispersion["tweedie"]),
            "surge_metrics": me.comparison(surge_long(t), surge_folds(t)),
            "surge_roc_curve": mt.roc_curve(surge_long(t), ["model"], "label", "score"),
            "surge_predictions": surge_table(t),
            "glm_feature_names": _names(t, severity(t).features),
            "surge_feature_names": _names(t, surge(t).features)}, path)
        return path
    return t.once("saved_results", save)


def _varying(columns, rows: str) -> str:
    return "SELECT " + " + ".join(f"CASE WHEN max({c}) > min({c}) THEN 1 ELSE 0 END" for c in columns) + f" FROM {rows}"


def _severity_rows(name: str, test: str) -> str:
    return (f"{name} AS (SELECT * FROM (SELECT {', '.join(f'{v} AS {c}' for c, v in SEVERITY_SQL.items())} FROM pf WHERE {test})"
            f" WHERE {' AND '.join(f'{c} IS NOT NULL' for c in SEVERITY_SQL)})")


@register("saved_result_tables", with_views("""SELECT 'gamma_coefficients' AS "table", CAST(1 + n AS BIGINT) AS n_rows FROM vg
 UNION ALL SELECT 'glm_feature_names', n FROM vg UNION ALL SELECT 'tweedie_coefficients', 1 + n FROM vt UNION ALL SELECT 'surge_coefficients', 1 + n FROM vs
 UNION ALL SELECT 'surge_feature_names', n FROM vs UNION ALL SELECT 'gamma_diagnostics', (SELECT count(*) FROM gte) UNION ALL SELECT 'tweedie_diagnostics', (SELECT count(*) FROM tte)
 UNION ALL SELECT 'surge_predictions', (SELECT count(*) FROM te)""", "pf", extra=", ".join([
    SURGE_CTE, _surge_rows("tr", f"<= {CUT}"), _surge_rows("te", f"> {CUT}"),
    _severity_rows("gtr", f"avg_claim_severity > 0 AND year <= {CUT}"), _severity_rows("gte", f"avg_claim_severity > 0 AND year > {CUT}"),
    _severity_rows("ttr", f"year <= {CUT}"), _severity_rows("tte", f"year > {CUT}"),
    f"vg AS (SELECT ({_varying(SEVERITY_SQL, 'gtr')}) AS n)", f"vt AS (SELECT ({_varying(SEVERITY_SQL, 'ttr')}) AS n)",
    f"vs AS (SELECT ({_varying(_SURGE_SQL, 'tr')}) AS n)"])))
def _(t: Tables):
    """Rows of the saved tables whose sizes follow from the data."""
    manifest = t.spark.read.parquet(f"{saved(t)}/{MANIFEST}")
    return manifest.filter(F.col("table").rlike("coefficients|feature_names|diagnostics|surge_predictions")).select("table", "n_rows")


@register("saved_thresholds", with_views(f"SELECT {rnd('ts', 6)} AS severity_threshold, {rnd('td', 6)} AS disaster_threshold, {rnd('tc', 6)} AS claims_paid_threshold FROM th",
                                         "pf", extra=LABEL_CTE), digits=6)
def _(t: Tables):
    """The thresholds of the label, read back from the saved results."""
    return load_result(t.spark, saved(t), "target_thresholds")
