"""Series preparation and fits on simulated histories with known properties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from perilframe.series import fits
from perilframe.series import forecast as fo
from perilframe.series import prepare as sr
from perilframe.series.fits import Order


def frame(spark, name, y, start="2010-01-01"):
    dates = pd.date_range(start, periods=len(y), freq="MS")
    return spark.createDataFrame([(name, d.date(), float(v)) for d, v in zip(dates, y)], "series string, date date, disaster_count double")


@pytest.fixture(scope="module")
def simulated(spark):
    rng = np.random.default_rng(1)
    e = rng.normal(size=241)
    ar = np.zeros(240)
    for t in range(1, 240):
        ar[t] = 0.7 * ar[t - 1] + e[t]
    season = 50 + 10 * np.sin(2 * np.pi * np.arange(240) / 12) + 0.1 * np.arange(240) + rng.normal(size=240)
    return {"ar": ar, "walk": np.cumsum(e[:240]), "ma": e[1:] + 0.6 * e[:-1], "season": season}


def test_missing_months_become_zero(spark):
    counts = spark.createDataFrame([("s", "2020-01-01", 2), ("s", "2020-04-01", 5)], "series string, d string, n long").select("series", F.to_date("d").alias("date"), "n")
    assert [r.n for r in sr.calendar_fill(counts, ["series"], "n").orderBy("date").collect()] == [2, 0, 0, 5]


def test_decomposition_of_an_exact_pattern(spark):
    t = np.arange(48)
    pattern = np.tile([3, -1, 0, 2, -2, 1, -3, 0, 4, -4, 1, -1], 4)
    rows = sr.decompose(frame(spark, "s", 10 + 0.5 * t + pattern), "disaster_count").orderBy("date").collect()
    assert rows[0].trend is None and rows[6].trend == pytest.approx(13.0)
    assert all(abs(r.resid) < 1e-9 for r in rows if r.resid is not None)
    assert [r.seasonal for r in rows[:12]] == pytest.approx(list(pattern[:12]))


def test_autocorrelation(spark, simulated):
    x = simulated["ar"] - simulated["ar"].mean()
    got = {r.lag: r.acf for r in sr.acf(frame(spark, "s", simulated["ar"]), "disaster_count", 5).collect()}
    assert got[0] == 1.0 and got[3] == pytest.approx((x[3:] * x[:-3]).sum() / (x * x).sum())
    partial = {r.lag: r.pacf for r in fo.pacf(frame(spark, "s", simulated["ar"]), max_lag=5).collect()}
    assert partial[1] == pytest.approx(got[1]) and all(abs(partial[k]) < 0.2 for k in (2, 3, 4, 5))


def test_unit_root(spark, simulated):
    both = frame(spark, "ar", simulated["ar"]).union(frame(spark, "walk", simulated["walk"]))
    got = {r.series: r for r in fo.stationarity(both).collect()}
    assert got["ar"].is_stationary and not got["walk"].is_stationary
    assert got["ar"].critical_5 == pytest.approx(-2.87, abs=0.01)


def test_fits_recover_parameters(simulated):
    x = simulated["ar"] - simulated["ar"].mean()
    fit = fits.fit_sarima(simulated["ar"], Order(1, 0, 0, 0, 0, 0))
    assert fit.theta[0] == pytest.approx((x[1:] @ x[:-1]) / (x[:-1] @ x[:-1]), abs=1e-6)  # least squares
    ar, ma = [], []
    for seed in range(20):
        e = np.random.default_rng(100 + seed).normal(size=401)
        y = np.zeros(400)
        for t in range(1, 400):
            y[t] = 0.7 * y[t - 1] + e[t]
        ar.append(fits.fit_sarima(y, Order(1, 0, 0, 0, 0, 0)).theta[0])
        ma.append(fits.fit_sarima(e[1:] + 0.6 * e[:-1], Order(0, 0, 1, 0, 0, 0)).theta[0])
    assert np.mean(ar) == pytest.approx(0.7, abs=0.04) and np.mean(ma) == pytest.approx(0.6, abs=0.04)
    assert fits.fit_sarima(np.arange(20.0), Order()) is None


def test_order_search_prefers_the_true_model(spark, simulated):
    searched = fo.order_search(frame(spark, "s", simulated["ar"]), [Order(p, d, 0, 0, 0, 0) for p in (0, 1) for d in (0, 1)])
    best = fo.best_orders(searched).first()
    assert (best.p, best.d) == (1, 0) and searched.count() == 4


@pytest.mark.parametrize("model", ["sarima", "trend"])
def test_forecasts_follow_the_season(spark, simulated, model):
    history = frame(spark, "s", simulated["season"][:228])
    ahead = fo.with_actuals(fo.forecast(history, 12, model, Order(0, 1, 1, 0, 1, 1)), frame(spark, "s", simulated["season"])).orderBy("date").toPandas()
    assert len(ahead) == 12 and (ahead.lower_ci < ahead.upper_ci).all()
    assert np.sqrt(((ahead.forecast - ahead.actual) ** 2).mean()) < 3.0


def test_cross_validation_and_comparison(spark, simulated):
    series = frame(spark, "s", simulated["season"])
    metrics = fo.forecast_cv(series, 3, "trend").unionByName(fo.forecast_cv(series, 3, "sarima", Order(0, 1, 1, 0, 1, 1)))
    rows = metrics.collect()
    assert len(rows) == 6 and all(r.n == 60 for r in rows)
    table = fo.compare(metrics, ["sarima", "trend"]).toPandas().set_index("metric")
    assert table.loc["rmse", "sarima"] == pytest.approx(np.mean([r.rmse for r in rows if r.model == "sarima"]))
