"""Distribution functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .columns import as_col

# Coefficients of the rational approximation of the inverse normal (P. J. Acklam).
_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00]
_TAIL = 0.02425


def _horner(coefficients: list[float], x: Column) -> Column:
    acc = F.lit(coefficients[0])
    for c in coefficients[1:]:
        acc = acc * x + F.lit(c)
    return acc


def normal_quantile(p) -> Column:
    """Inverse standard normal, relative error below 1.2e-9."""
    p = as_col(p)
    q = p - 0.5
    r = q * q
    centre = _horner(_A, r) * q / _horner(_B + [1.0], r)
    low = F.sqrt(-2.0 * F.log(p))
    high = F.sqrt(-2.0 * F.log(1.0 - p))

    def tail(x: Column) -> Column:
        return _horner(_C, x) / _horner(_D + [1.0], x)

    return (F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
            .when(p < _TAIL, tail(low)).when(p > 1 - _TAIL, -tail(high)).otherwise(centre))


def kolmogorov_pvalue(statistic, n1, n2, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value of the two-sample Kolmogorov-Smirnov statistic."""
    d, a, b = (as_col(c).cast("double") for c in (statistic, n1, n2))
    lam2 = d * d * (a * b / (a + b))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam2))
    return F.when(lam2 < 0.04, 1.0).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))
