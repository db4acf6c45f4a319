"""Missing values, padding, rounding and coercion at the edges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from perilframe.functions import columns as fc
from perilframe.functions import stats as st


def values(spark, rows, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


def test_padding_never_truncates(spark):
    rows = [("1",), ("01",), ("12345",), ("123456",), (None,)]
    got = values(spark, rows, "c string", fc.pad_code("c", 2), fc.pad_code("c", 3, "000"), fc.pad_code("c", 5))
    assert got == [("01", "001", "00001"), ("01", "001", "00001"), ("12345", "12345", "12345"),
                   ("123456", "123456", "123456"), (None, "000", None)]
    assert values(spark, [("1", None)], "s string, c string", fc.compose_key("s", "c"), fc.is_statewide("c")) == [("01000", True)]


def test_nan_and_null_are_never_above_a_threshold(spark):
    rows = [(float("nan"),), (None,), (4.999,), (5.0,), (5.001,)]
    df = spark.createDataFrame(rows, "x double").select(fc.no_nan("x").alias("x"))
    assert [r[0] for r in df.select(fc.flag(F.col("x") >= 5)).collect()] == [0, 0, 0, 1, 1]
    assert [r[0] for r in df.select(fc.flag(F.col("x") > 5)).collect()] == [0, 0, 0, 0, 1]


def test_unreadable_text_becomes_null(spark):
    rows = [("12.5",), ("abc",), ("",), (".",), (None,), ("NaN",)]
    assert [r[0] for r in values(spark, rows, "c string", fc.number("c"))] == [12.5, None, None, None, None, None]
    assert [r[0] for r in values(spark, rows, "c string", fc.number_or_zero("c"))] == [12.5, 0, 0, 0, 0, 0]
    dates = [("2024-02-29T00:00:00.000Z",), ("2024-02-30",), ("not a date",)]
    assert values(spark, dates, "c string", fc.timestamp("c").cast("date")) == [(dt.date(2024, 2, 29),), (None,), (None,)]


def test_duration_rounds_half_to_even(spark):
    begin = dt.datetime(2020, 1, 1)
    rows = [(begin, begin + dt.timedelta(days=d)) for d in (1.25, 1.75, 2.25, -0.25)] + [(begin, None)]
    assert [r[0] for r in values(spark, rows, "b timestamp, e timestamp", fc.duration_days("b", "e"))] == [1.2, 1.8, 2.2, -0.2, None]


def test_ratios_guard_the_denominator(spark):
    rows = [(6.0, 3.0), (6.0, 0.0), (6.0, -1.0), (6.0, None), (None, 2.0)]
    assert [r[0] for r in values(spark, rows, "n double, d double", fc.guarded_ratio("n", "d"))] == [2.0, 0.0, 0.0, 0.0, None]
    assert [r[0] for r in values(spark, rows, "n double, d double", fc.change_rate("n", "d"))] == [1.0, None, None, None, None]


def test_lookups_bands_and_index(spark):
    rows = [("Fire", 0.0005, 3.0), ("Moon", 0.02, None), (None, 0.2, 1.0)]
    got = values(spark, rows, "t string, p double, w double", fc.lookup("t", {"Fire": "Wildfire"}, "Other"), fc.significance("p"),
                 fc.band("p", [(0.1, "high"), (0.01, "mid")], "low"), fc.weighted_index(["w"], {"w": 2.0, "absent": 9.0}))
    assert got == [("Wildfire", "***", "low", 6.0), ("Other", "*", "mid", 0.0), ("Other", "", "high", 2.0)]


def test_normal_quantile_and_ks_pvalue(spark):
    got = values(spark, [(0.5,), (0.975,), (0.001,), (0.0,)], "p double", st.normal_quantile("p"))
    assert got[0][0] == pytest.approx(0.0, abs=1e-12) and got[1][0] == pytest.approx(1.959963985, abs=1e-8)
    assert got[2][0] == pytest.approx(-3.090232306, abs=1e-7) and got[3][0] is None
    p = values(spark, [(0.1, 100, 100), (1.0, 500, 500), (0.0, 50, 50)], "d double, a long, b long", st.kolmogorov_pvalue("d", "a", "b"))
    assert p[0][0] == pytest.approx(0.69937, abs=1e-4) and p[1][0] == pytest.approx(0, abs=1e-12) and p[2][0] == 1.0
