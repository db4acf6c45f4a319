"""Scalar column expressions with the missing-value and rounding rules of the panel."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def no_nan(c) -> Column:
    """NaN becomes NULL, so that comparisons with a missing value are never true."""
    c = as_col(c).cast("double")
    return F.when(~F.isnan(c), c)


def flag(condition: Column) -> Column:
    """0/1; an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def zero_pad(c, width: int) -> Column:
    """Left-pad with zeros up to ``width``; longer values are kept whole."""
    c = as_col(c).cast("string")
    return F.lpad(c, F.greatest(F.length(c), F.lit(width)), F.lit("0"))


def pad_code(c, width: int, missing: str | None = None) -> Column:
    c = as_col(c).cast("string")
    return zero_pad(c if missing is None else F.coalesce(c, F.lit(missing)), width)


def compose_key(state, county) -> Column:
    return F.concat(pad_code(state, 2, "00"), pad_code(county, 3, "000"))


def is_statewide(county) -> Column:
    return pad_code(county, 3, "000") == "000"


def key_prefix(c, n: int = 2) -> Column:
    return F.substring(as_col(c), 1, n)


def lookup(c, table: dict, default=None) -> Column:
    """Dictionary lookup as a literal map; unknown keys give ``default`` (NULL when omitted)."""
    entries = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    found = F.try_element_at(entries, as_col(c))
    return found if default is None else F.coalesce(found, F.lit(default))


def number(c) -> Column:
    """Text to double; unreadable text and NaN give NULL."""
    return no_nan(as_col(c).try_cast("double"))


def number_or_zero(c) -> Column:
    return F.coalesce(number(c), F.lit(0.0))


def timestamp(c) -> Column:
    return as_col(c).try_cast("timestamp")


def month_start(year, month) -> Column:
    return F.make_date(as_col(year), as_col(month), F.lit(1))


def duration_days(begin, end, decimals: int = 1) -> Column:
    """Elapsed days between two timestamps, rounded half to even."""
    seconds = (F.unix_micros(as_col(end)) - F.unix_micros(as_col(begin))) / F.lit(1e6)
    return F.bround(seconds / F.lit(86400.0), decimals)


def guarded_ratio(numerator, denominator, otherwise=0.0) -> Column:
    n, d = as_col(numerator).cast("double"), as_col(denominator).cast("double")
    return F.when(d > 0, n / d).otherwise(F.lit(otherwise).cast("double"))


def change_rate(current, previous) -> Column:
    """Relative change; NULL unless the previous value is positive."""
    return guarded_ratio(as_col(current) - as_col(previous), previous, None)


def total(*cols) -> Column:
    """Sum of columns, each missing term counted as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(as_col(c), F.lit(0.0)) for c in cols])


def weighted_index(available: list[str], weights: dict[str, float]) -> Column:
    """Weighted sum over the weighted columns that exist; absent ones add nothing."""
    return total(*[F.col(c) * F.lit(w) for c, w in weights.items() if c in available])


def clip(c, low: float, high: float) -> Column:
    return F.least(F.greatest(as_col(c), F.lit(low)), F.lit(high))


def indicator(c, value) -> Column:
    return F.when(as_col(c) == F.lit(value), 1.0).otherwise(0.0)


def significance(p) -> Column:
    p = as_col(p)
    return (F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise(""))


def band(c, steps: list[tuple[float, str]], otherwise: str, above: bool = True) -> Column:
    """First label whose limit is exceeded (or, with ``above=False``, undercut)."""
    c = as_col(c)
    expr = None
    for limit, label in steps:
        test = (c > limit) if above else (c < limit)
        expr = F.when(test, label) if expr is None else expr.when(test, label)
    return expr.otherwise(otherwise)


def percent_effect(exp_coef) -> Column:
    return (as_col(exp_coef) - 1.0) * 100.0


def random_order(*keys, seed: int = 42) -> Column:
    """Deterministic shuffle key; the same text hashes the same way in every engine."""
    return F.md5(F.concat_ws("|", *[as_col(k).cast("string") for k in keys], F.lit(str(seed))))
