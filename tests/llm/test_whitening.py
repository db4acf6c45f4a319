"""Whitening against whole-number products and NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilframe.llm import whitening

VECTORS = "vec_id long, embedding array<double>"


def scaled(vectors):
    return np.array([[math.floor(64 * c) + 1_000_000 for c in vector] for vector in vectors], dtype=object)


def brute(vectors, components=16):
    """Counts, deviations, shares and whitened rows (up to the sign of each component) from Python's whole numbers."""
    x = scaled(vectors)
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    products = n * (fit.T @ fit) - np.outer(sums, sums)
    covariance = np.array([[value / (n * n) for value in line] for line in products], dtype=float)
    values, directions = np.linalg.eigh(covariance)
    order = [k for k in np.argsort(-values) if values[k] > 1e-12 * values.sum()][:components]
    centred = n * x - sums
    made = (centred / n).astype(float) @ directions[:, order] / np.sqrt(values[order])
    return n, (centred ** 2).sum(axis=1), values[order] / values.sum(), made


def table(spark, vectors):
    return spark.createDataFrame([(n, [float(c) for c in vector]) for n, vector in enumerate(vectors)], VECTORS)


@pytest.mark.parametrize("scale,rows,dim", [(1.0, 500, 24), (0.01, 300, 8), (4e6, 200, 20), (1.0, 5000, 3)])
def test_matches_brute_force(spark, scale, rows, dim):
    draw = np.random.default_rng(rows)
    vectors = draw.normal(size=(rows, dim)) * scale * np.linspace(1, 3, dim)
    vectors[rows // 2:rows // 2 + 40] = vectors[0]
    got = whitening.whitened(table(spark, vectors).repartition(5)).toPandas().sort_values(["vec_id", "component"])
    n, deviation, explained, made = brute(vectors)
    count = made.shape[1]
    assert len(got) == rows * count and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    mine = got["whitened"].to_numpy().reshape(rows, count)
    assert np.abs(mine * np.sign((mine * made).sum(axis=0)) - made).max() < 1e-8
    assert np.allclose(got["explained"].to_numpy().reshape(rows, count)[0], explained, rtol=1e-9)
    told = [None if np.isnan(value) else int(value) for value in got["deviation"][::count]] if scale > 1e6 else got["deviation"][::count].tolist()
    assert told == [value if value < 1 << 63 else None for value in deviation.tolist()]


def test_scatter_is_exact(spark):
    draw = np.random.default_rng(3)
    x = draw.integers(-(1 << 40), 1 << 40, size=(700, 5))
    x[:, 2] = 7  # no plane at all
    low, high = x.min(axis=0).tolist(), x.max(axis=0).tolist()
    frame = spark.createDataFrame([(line,) for line in x.tolist()], "x array<long>").repartition(3)
    got = whitening.scatter(frame, low, [(b - a).bit_length() for a, b in zip(low, high)])
    shifted = x.astype(object) - np.array(low, dtype=object)
    assert got == (shifted.T @ shifted).tolist()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [0.25, -1.0]), (2, None), (3, []), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [None, 1.0]),
            (7, [0.0, 0.0]), (8, [1.0, 2.0, 3.0]), (9, [1e300, -1e300])]
    frame = spark.createDataFrame(rows, VECTORS).select("*", F.lit(1).alias("x"), F.lit(2).alias("dim"), F.lit("l").alias("label"))
    got = whitening.whitened(frame).collect()
    assert {row["vec_id"] for row in got} == {1, None, 7, 9}  # 8 is alone in its space and has no variance
    assert sum(row["vec_id"] == 1 for row in got) == 2 * sum(row["vec_id"] == 7 for row in got)
    assert {row["n"] for row in got} == {4} and {row["deviation"] for row in got if row["vec_id"] == 9} == {None}


def test_one_vector_and_nothing(spark):
    assert whitening.whitened(table(spark, [[1.0, 2.0]] * 9)).count() == 0
    assert whitening.whitened(table(spark, [])).count() == 0


def test_fewer_directions_than_components(spark):
    vectors = np.outer(np.arange(-20, 21), [1.0, 2.0, -1.0])
    got = whitening.whitened(table(spark, vectors)).toPandas()
    assert set(got["component"]) == {1} and np.allclose(got["explained"], 1) and got["identity_error"].max() < 1e-9
