"""Severity and surge regressions with Spark ML."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, functions as F

from ..functions import columns as fc
from ..functions import fixed_values as fv
from ..operators import metrics as mt
from ..operators import splits as sp
from ..session import scratch_path
from ..sources.sinks import write_stage
from . import features as ft


@dataclass
class Prepared:
    """An assembled frame with a ``split`` column, and the names of its features."""

    frame: DataFrame
    features: list[str]

    @property
    def train(self) -> DataFrame:
        return self.frame.filter(F.col("split") == "train")

    @property
    def test(self) -> DataFrame:
        return self.frame.filter(F.col("split") == "test")


def varying(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns that are not constant; a constant one would make the fit singular."""
    row = df.agg(*[(F.max(c) > F.min(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def prepare(panel: DataFrame, features: list[str], label: str, cut: int = fv.TRAIN_YEAR_MAX,
            keep: tuple[str, ...] = ("county_fips", "year"), scale: bool = True) -> Prepared:
    """Region indicators, complete rows, unit scaling, temporal split and assembly."""
    wide = ft.region_dummies(panel)
    names = ft.available(wide, features) + [f"fema_region_{r}" for r in fv.REGIONS]
    rows = wide.select(*keep, F.col(label).cast("double").alias("label"), *[F.col(n).cast("double").alias(n) for n in names])
    rows = rows.filter(F.col("label").isNotNull() & ft.all_known(names))
    if scale:
        rows = ft.scale_units(rows)
    split = sp.temporal(rows, cut)
    names = varying(split.filter(F.col("split") == "train"), names)
    return Prepared(ft.assemble(split, names).select(*keep, "label", "split", *names, "features"), names)


def severity_data(panel: DataFrame, cut: int = fv.TRAIN_YEAR_MAX, with_zeros: bool = False) -> Prepared:
    """Positive severities for the Gamma fit; with zeros for the Tweedie fit."""
    kept = panel.fillna(0, ["avg_claim_severity"]) if with_zeros else panel.filter(F.col("avg_claim_severity") > 0)
    return prepare(kept, fv.SEVERITY_FEATURES, "avg_claim_severity", cut)


def surge_data(base: DataFrame, threshold: float = 0.5, cut: int = fv.TRAIN_YEAR_MAX,
               features: list[str] = fv.SURGE_FEATURES) -> Prepared:
    """0/1 surge label on standardised features; the standardisation is fitted on the training years."""
    labelled = base.withColumn("surge", fc.flag(F.col("claims_change_yoy") > threshold))
    plain = prepare(labelled, features, "surge", cut, scale=False)
    scaled = ft.standardise(plain.frame.drop("features"), ft.moments(plain.train, plain.features))
    return Prepared(ft.assemble(scaled, plain.features), plain.features)


def fit_glm(train: DataFrame, family: str, power: float | None = None, max_iter: int = 100, weight: str | None = None):
    """Gamma or Tweedie with log link, or Binomial with logit link, by iteratively reweighted least squares."""
    glm = GeneralizedLinearRegression(family=family, maxIter=max_iter, labelCol="label", featuresCol="features")
    if family == "tweedie":
        glm = glm.setVariancePower(power).setLinkPower(0.0)
    else:
        glm = glm.setLink("logit" if family == "binomial" else "log")
    if weight:
        glm = glm.setWeightCol(weight)
    return glm.fit(train)


def predict_severity(model, df: DataFrame) -> DataFrame:
    """Predictions kept within [1, 1e7]."""
    return model.transform(df).withColumn("predicted", fc.clip("prediction", 1.0, 1e7))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def coefficient_table(model, features: list[str], name: str) -> DataFrame:
    """Coefficient, error, z, p, exponentiated effect with 95 % interval; one row per feature.

    p-values use the normal distribution, also where the dispersion is estimated.
    """
    from pyspark.sql import SparkSession
    spark = SparkSession.active()
    errors = model.summary.coefficientStandardErrors
    names = ["intercept", *features]
    betas = [model.intercept, *model.coefficients]
    sigmas = [errors[-1], *errors[:-1]]  # Spark lists the intercept last
    rows = []
    for feature, beta, se in zip(names, betas, sigmas):
        z = beta / se if se > 0 else float("nan")
        p = normal_two_sided(z)
        safe = [math.exp(v) if v < 709.0 else math.inf for v in (beta, beta - 1.959963984540054 * se, beta + 1.959963984540054 * se)]
        rows.append((feature, float(beta), float(se), float(z), p, *safe, p < 0.05, name))
    return spark.createDataFrame(rows, "feature string, coefficient double, std_err double, z_value double, p_value double, "
                                       "exp_coef double, ci_lower double, ci_upper double, significant boolean, model string")


def evaluate_glm(model, test: DataFrame, name: str, n_train: int) -> DataFrame:
    """Test errors beside the fit statistics of the training summary."""
    s = model.summary
    errors = mt.regression_metrics(predict_severity(model, test), [], "label", "predicted")
    # Spark defines no AIC for the tweedie family.
    aic = None if model.getFamily() == "tweedie" else float(s.aic)
    return errors.select(F.lit(name).alias("model"), F.lit(aic).cast("double").alias("aic"), F.lit(float(s.deviance)).alias("deviance"),
                         F.lit(float(s.dispersion)).alias("scale"), F.col("rmse").alias("test_rmse"), F.col("mae").alias("test_mae"),
                         F.col("r2").alias("test_r2"), F.col("mape").alias("test_mape"), F.lit(n_train).alias("n_train"), F.col("n").alias("n_test"))


def quasi_criterion(model, train: DataFrame, power: float) -> float:
    """Minus twice the extended quasi-likelihood plus twice the parameter count, as one aggregate.

    Zeros enter the variance function as y + 1/6.
    """
    y, mu, p = F.col("label"), F.col("prediction"), power
    unit = 2 * (F.when(y > 0, F.pow(y, 2 - p)).otherwise(0.0) / ((1 - p) * (2 - p)) - y * F.pow(mu, 1 - p) / (1 - p) + F.pow(mu, 2 - p) / (2 - p))
    phi = float(model.summary.dispersion)
    value = model.transform(train).agg(F.sum(unit / phi + F.log(F.lit(2 * math.pi * phi) * F.pow(y + 1.0 / 6.0, p)))).first()[0]
    return float(value) + 2.0 * (len(model.coefficients) + 1)


def tweedie_power_search(data: Prepared, powers=(1.1, 1.2, 1.3, 1.4, 1.5, 1.6, 1.7, 1.8, 1.9), max_iter: int = 100):
    """Fit every power on the cached training rows; prefer converged fits, then the lowest criterion.

    Returns the best model, its power and the comparison rows.
    """
    train = data.train.persist()
    rows, models = [], {}
    try:
        for power in powers:
            try:
                model = fit_glm(train, "tweedie", power, max_iter)
                models[power] = model
                rows.append((float(power), quasi_criterion(model, train, power), float(model.summary.deviance),
                             model.summary.numIterations < max_iter))
            except Exception:  # a fit may diverge; it is reported as such
                rows.append((float(power), None, None, False))
    finally:
        train.unpersist()
    usable = [r for r in rows if r[3] and r[1] is not None] or [r for r in rows if r[1] is not None]
    best = min(usable, key=lambda r: r[1])[0]
    frame = data.frame.sparkSession.createDataFrame(rows, "power double, criterion double, deviance double, converged boolean")
    return models[best], best, frame


def cross_validate_gamma(data: Prepared, keys: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Out-of-fold RMSE and MAE per fold; all folds are measured in one aggregate."""
    spark = data.frame.sparkSession
    folded = write_stage(sp.kfold(data.frame, keys, k, seed), scratch_path(spark, "folds"))
    parts = []
    for fold in range(1, k + 1):
        model = fit_glm(folded.filter(F.col("fold") != fold), "gamma")
        parts.append(predict_severity(model, folded.filter(F.col("fold") == fold)).select("fold", "label", "predicted"))
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    return mt.regression_metrics(scored, ["fold"], "label", "predicted").select("fold", "rmse", "mae")


def fit_balanced_logit(train: DataFrame, max_iter: int = 1000, tol: float = 1e-10):
    """Class-balanced logistic regression with an L2 penalty of one, on standardised features."""
    weighted = ft.with_balanced_weight(train, "label").persist()
    try:
        total = weighted.agg(F.sum("weight")).first()[0]
        logit = LogisticRegression(labelCol="label", featuresCol="features", weightCol="weight", maxIter=max_iter, tol=tol,
                                   regParam=1.0 / total, elasticNetParam=0.0, standardization=False)
        return ft.without_summary(logit.fit(weighted))
    finally:
        weighted.unpersist()


def with_score(model, df: DataFrame) -> DataFrame:
    """Probability of the positive class as a plain ``score`` column."""
    return model.transform(df).withColumn("score", vector_to_array("probability")[1])
